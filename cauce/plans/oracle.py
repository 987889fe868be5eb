"""DuckDB SQL for the derived views, used to build the oracle queries.

Each view here is the SQL twin of a function in ``cauce.sources.tables``;
``with_views(sql, *names)`` prefixes a query with the CTEs it needs so every
oracle query is a standalone statement over the driver's tables.
"""

from __future__ import annotations

from cauce.functions import rules as R
from cauce.sources.tables import CITIES, PRODUCT_NAMES


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS: dict[str, str] = {}

VIEWS["requests"] = """
requests AS (
  SELECT o_orderkey AS id, o_custkey AS solicitante_id, o_totalprice AS presupuesto_max,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ALTA' WHEN '2' THEN 'Alta'
      WHEN '3' THEN 'media' WHEN '5' THEN 'baja' WHEN '4' THEN 'normal' END AS urgencia,
    CAST(o_orderdate AS DATE) AS fecha_solicitud,
    CASE o_orderstatus WHEN 'O' THEN 'pendiente' WHEN 'F' THEN 'completada'
      ELSE 'en_proceso' END AS estado
  FROM orders)"""

VIEWS["quotes"] = f"""
quotes AS (
  SELECT l_orderkey AS solicitud_id, l_partkey AS producto_id,
    ({_sql_list(PRODUCT_NAMES)})[l_partkey % {len(PRODUCT_NAMES)} + 1] AS producto,
    l_suppkey AS proveedor_id, l_linenumber AS linea, l_extendedprice AS precio_total,
    l_quantity AS plazo_dias, CAST(round(l_tax * 100) AS INTEGER) AS garantia_meses,
    l_discount * 400 AS risk_score, l_shipdate AS "timestamp"
  FROM lineitem)"""

VIEWS["quotes_named"] = """
quotes_named AS (
  SELECT q.*, s.s_name AS proveedor_nombre
  FROM quotes q LEFT JOIN supplier s ON s.s_suppkey = q.proveedor_id)"""

_BODY = "(5000000 + (s_suppkey * 7919) % 90000000)"
_GOOD = (f"CAST({_BODY} // 1000000 AS VARCHAR) || '.' || "
         f"lpad(CAST(({_BODY} // 1000) % 1000 AS VARCHAR), 3, '0') || '.' || "
         f"lpad(CAST({_BODY} % 1000 AS VARCHAR), 3, '0') || '-' || "
         f"substr('0123456789K', CAST(s_suppkey % 11 + 1 AS INTEGER), 1)")
VIEWS["suppliers"] = f"""
suppliers AS (
  SELECT s_suppkey AS id, s_name AS nombre,
    CASE WHEN s_suppkey % 13 = 0 THEN NULL
         WHEN s_suppkey % 9 = 0 THEN CAST({_BODY} AS VARCHAR) || '-' ||
              substr('0123456789K', CAST(s_suppkey % 11 + 1 AS INTEGER), 1)
         WHEN s_suppkey % 17 = 0 THEN ' ' || chr(9) || {_GOOD} || ' '
         ELSE {_GOOD} END AS rut,
    'ventas' || CAST(s_suppkey AS VARCHAR) || '@proveedor.cl' AS email,
    s_nationkey AS categoria_id, s_acctbal AS reputacion_score
  FROM supplier)"""

_PRICE_TXT = "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"
VIEWS["sales_raw"] = f"""
sales_raw AS (
  SELECT event_id AS id,
    CASE WHEN event_id % 29 = 0 THEN NULL
         WHEN event_id % 23 = 0 THEN strftime(CAST(ts AS DATE), '%Y/%m/%d')
         WHEN event_id % 31 = 0 THEN strftime(CAST(ts AS DATE), '%d-%m-%Y')
         ELSE strftime(CAST(ts AS DATE), '%Y-%m-%d') END AS fecha,
    CASE WHEN event_id % 37 = 0 THEN '  ' ELSE event_type END AS producto,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'dos'
         WHEN event_id % 17 = 0 THEN '0' WHEN event_id % 19 = 0 THEN '600'
         ELSE CAST(user_id % 9 + 1 AS VARCHAR) END AS cantidad,
    CASE WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 43 = 0 THEN '-' || {_PRICE_TXT}
         WHEN event_id % 47 = 0 THEN '0' ELSE {_PRICE_TXT} END AS precio,
    CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN ''
         ELSE ({_sql_list(CITIES)})[user_id % {len(CITIES)} + 1] END AS ciudad,
    CASE WHEN event_id % 5 = 0 THEN NULL
         ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1.25 END AS descuento
  FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error') e)"""

VIEWS["portfolio"] = """
portfolio AS (
  SELECT c.c_custkey AS cliente_id,
    CAST(18 + (c.c_custkey * 7) % 52 AS INTEGER) AS edad,
    CAST(coalesce(floor((CAST(p.last_order AS DATE) - CAST(p.first_order AS DATE)) / 365), 0) AS INTEGER) AS anos_cliente,
    coalesce(p.spend, 0.0) / 50000 AS uso_datos_gb,
    CAST(coalesce(p.n_orders, 0) AS INTEGER) AS llamadas_mes,
    CAST(coalesce(p.urgent, 0) AS INTEGER) AS reclamos,
    CAST(c.c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS plan_premium,
    CAST(p.last_order IS NULL OR CAST(p.last_order AS DATE) <
         (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 365 AS INTEGER) AS abandona
  FROM customer c LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend,
      min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
      count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
    FROM orders GROUP BY o_custkey) p ON c.c_custkey = p.o_custkey)"""

VIEWS["scored_lines"] = """
scored_lines AS (
  SELECT l_orderkey AS id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
    l_discount * 10 AS score, CAST(l_discount * 10 >= 0.5 AS INTEGER) AS pred
  FROM lineitem)"""

VIEWS["negotiations"] = """
negotiations AS (
  SELECT conv_id * 100000 + ronda AS id, conv_id AS cotizacion_id, ronda,
    min(text) FILTER (WHERE role = 'user') AS email_enviado,
    min(text) FILTER (WHERE role = 'assistant') AS email_recibido
  FROM (SELECT *, CAST(floor(turn / 2) + 1 AS INTEGER) AS ronda FROM conversations) t GROUP BY conv_id, ronda)"""

# every ninth customer's use is not known: NaN in the engine's frame, NULL here
VIEWS["portfolio_gaps"] = """
portfolio_gaps AS (
  SELECT * REPLACE (CASE WHEN cliente_id % 9 = 0 THEN NULL ELSE uso_datos_gb END AS uso_datos_gb) FROM portfolio)"""

# views that depend on others
_DEPS = {"quotes_named": ["quotes"], "portfolio_gaps": ["portfolio"]}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql.strip()
    ctes = ",".join(VIEWS[n] for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ctes + ",\n" + body[5:]
    return "WITH " + ctes + "\n" + body


# SQL twins of the rule expressions --------------------------------------

def sql_urgency_category(c: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.URGENCY_CATEGORY.items())
    return f"coalesce(CASE lower({c}) {whens} END, '{R.URGENCY_DEFAULT}')"


def sql_right_closed(c: str, bins) -> str:
    whens = " ".join(f"WHEN {c} > {lo} AND {c} <= {hi} THEN '{lab}'" for lo, hi, lab in bins)
    return f"CASE {whens} END"


def sql_price_in_range(price: str, product: str) -> str:
    whens = " ".join(
        f"WHEN coalesce(contains(lower({product}), '{kw.lower()}'), false) THEN "
        f"coalesce({price} >= {lo} AND {price} <= {hi}, false)"
        for kw, lo, hi in R.PRICE_RANGES)
    return f"CASE {whens} ELSE true END"


def sql_segment(p: str) -> str:
    return (f"CASE WHEN {p} >= {R.SEGMENT_HIGH} THEN 'ALTO' WHEN {p} >= {R.SEGMENT_MEDIUM} "
            f"THEN 'MEDIO' WHEN {p} IS NOT NULL THEN 'BAJO' END")


def sql_action(seg: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.RETENTION_ACTION.items())
    return f"CASE {seg} {whens} END"


def sql_age_band(c: str) -> str:
    whens = " ".join(f"WHEN {c} < {u} THEN '{lab}'" for u, lab in R.AGE_BANDS)
    return f"CASE {whens} WHEN {c} IS NOT NULL THEN '{R.AGE_BAND_TOP}' END"


def sql_strip(c: str) -> str:
    return f"trim({c}, '{R.WS_CHARS}')"


def sql_numeric_form(c: str) -> str:
    return f"translate({sql_strip(c)}, '{R.DIGITS_FROM}', '{R.DIGITS_TO}')"


def sql_to_double(c: str) -> str:
    t = sql_numeric_form(c)
    return f"CASE WHEN regexp_matches({t}, '{R.NUMERIC_TEXT}') THEN TRY_CAST({t} AS DOUBLE) END"


def sql_is_numeric(c: str) -> str:
    return f"({c} IS NULL OR coalesce(regexp_matches({sql_numeric_form(c)}, '{R.NUMERIC_TEXT}'), false))"


def sql_to_date(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '{R.ISO_DATE_TEXT}') "
            f"THEN TRY_CAST(try_strptime({c}, '%Y-%m-%d') AS DATE) END")


DEMO_SALT = "cauce-demo-salt"  # of the registered queries, which run on invented data


def sql_pseudonym(c: str, salt: str = DEMO_SALT) -> str:
    return f"substr(sha256('{salt}:' || CAST({c} AS VARCHAR)), 1, {R.PSEUDONYM_HEX_CHARS})"
