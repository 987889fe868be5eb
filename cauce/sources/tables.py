"""Reference-shaped views over the driver's Parquet tables.

The reference works on purchase requests, supplier quotes, a supplier
catalogue, raw sales text and a subscriber portfolio.  The driver ships
TPC-H-like tables instead; these functions derive the reference's tables
from them with plain projections (and one aggregate for the portfolio), so
every operator downstream runs over whole tables and grows with them.

Each view only selects the columns it needs, so the Parquet scan prunes
columns and receives any filter the caller adds (PushedFilters).
The matching DuckDB SQL for each view lives in ``cauce.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Product names for quotes, chosen by l_partkey modulo their count.  They
# carry the keywords of the price-range rule (one compound name checks the
# first-keyword-wins order, the last one has no keyword).
PRODUCT_NAMES = [
    "Laptops", "Resmas", "Toner", "Sillas", "Servidor", "Escritorios", "Licencias",
    "Cables", "Monitores", "Extinguidores", "Router", "Papel", "Camaras", "Antivirus",
    "Mesas", "Resmas de papel", "Insumos varios",
]
CITIES = ["Santiago", "Valparaiso", "Concepcion", "Temuco", "Antofagasta", "Talca"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------------------
# procurement
# ---------------------------------------------------------------------------

def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase requests (solicitudes) from ``orders``.

    urgency: priority 1 → 'ALTA', 2 → 'Alta', 3 → 'media', 5 → 'baja',
    4 → 'normal' (not a known urgency, exercises the default).
    status: O → pendiente, F → completada, P → en_proceso.
    """
    o = table(spark, sf_dir, "orders")
    prio = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("solicitante_id"),
        F.col("o_totalprice").alias("presupuesto_max"),
        F.when(prio == "1", "ALTA").when(prio == "2", "Alta").when(prio == "3", "media")
        .when(prio == "5", "baja").when(prio == "4", "normal").alias("urgencia"),
        F.col("o_orderdate").cast("date").alias("fecha_solicitud"),
        F.when(F.col("o_orderstatus") == "O", "pendiente")
        .when(F.col("o_orderstatus") == "F", "completada")
        .otherwise("en_proceso").alias("estado"),
    )


def quotes(spark: SparkSession, sf_dir: str, with_names: bool = False) -> DataFrame:
    """Supplier quotes (cotizaciones) from ``lineitem``.

    request = l_orderkey, product = l_partkey, supplier = l_suppkey,
    price = l_extendedprice, lead days = l_quantity, risk = l_discount*400,
    warranty months = round(l_tax*100), ts = l_shipdate; ``linea`` keeps
    l_linenumber as a tie-break.  ``with_names`` adds the supplier name
    (a join with ``supplier`` that AQE may turn into a broadcast when the
    measured side is small; no hint, so it stays a shuffle join at scale).
    """
    q = quotes_from(table(spark, sf_dir, "lineitem"))
    if with_names:
        s = table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("proveedor_id"), F.col("s_name").alias("proveedor_nombre"))
        q = q.join(s, "proveedor_id", "left")
    return q


def quotes_from(li: DataFrame) -> DataFrame:
    """The quote projection over a lineitem-shaped frame (batch or stream)."""
    names = F.array(*[F.lit(n) for n in PRODUCT_NAMES])
    return li.select(
        F.col("l_orderkey").alias("solicitud_id"),
        F.col("l_partkey").alias("producto_id"),
        F.element_at(names, (F.pmod("l_partkey", F.lit(len(PRODUCT_NAMES))) + 1).cast("int"))
        .alias("producto"),
        F.col("l_suppkey").alias("proveedor_id"),
        F.col("l_linenumber").alias("linea"),
        F.col("l_extendedprice").alias("precio_total"),
        F.col("l_quantity").alias("plazo_dias"),
        F.round(F.col("l_tax") * 100).cast("int").alias("garantia_meses"),
        (F.col("l_discount") * 400).alias("risk_score"),
        F.col("l_shipdate").alias("timestamp"),
    )


def rut_text(key) -> F.Column:
    """A Chilean-style RUT text derived from an integer key, with malformed rows.

    body = 5,000,000 + (key*7919 mod 90,000,000); check char from '0123456789K'.
    key%13==0 → null, key%9==0 → digits without dots, key%17==0 → padded with
    whitespace (valid after a full strip), otherwise NN.NNN.NNN-D.
    """
    k = F.col(key) if isinstance(key, str) else key
    # the key is reduced first, so that no key overflows
    body = F.lit(5000000) + F.pmod(F.pmod(k, F.lit(90000000)) * 7919, F.lit(90000000))
    head = F.floor(body / 1000000).cast("string")
    mid = F.lpad(F.pmod(F.floor(body / 1000), F.lit(1000)).cast("string"), 3, "0")
    tail = F.lpad(F.pmod(body, F.lit(1000)).cast("string"), 3, "0")
    dv = F.substring(F.lit("0123456789K"), (F.pmod(k, F.lit(11)) + 1).cast("int"), 1)
    good = F.concat(head, F.lit("."), mid, F.lit("."), tail, F.lit("-"), dv)
    return (F.when(F.pmod(k, F.lit(13)) == 0, F.lit(None).cast("string"))
            .when(F.pmod(k, F.lit(9)) == 0, F.concat(body.cast("string"), F.lit("-"), dv))
            .when(F.pmod(k, F.lit(17)) == 0, F.concat(F.lit(" \t"), good, F.lit(" ")))
            .otherwise(good))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier catalogue (proveedores) from ``supplier``."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("nombre"),
        rut_text("s_suppkey").alias("rut"),
        F.concat(F.lit("ventas"), F.col("s_suppkey").cast("string"), F.lit("@proveedor.cl")).alias("email"),
        F.col("s_nationkey").alias("categoria_id"),
        F.col("s_acctbal").alias("reputacion_score"),
    )


# ---------------------------------------------------------------------------
# sales cleaning
# ---------------------------------------------------------------------------

def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sales text (ventas_raw) from ``events``; every field is text.

    Bad values are injected by event id so every validator fires:
    fecha: id%23 → 'yyyy/MM/dd', id%29 → null, id%31 → 'dd-MM-yyyy';
    producto: id%37 → blank; cantidad: id%11 → 'dos', id%13 → null,
    id%17 → '0', id%19 → '600'; precio: id%7 → 'abc', id%43 → negative,
    id%47 → '0'; ciudad: id%53 → null, id%59 → ''; descuento from the
    ``k`` field of ``props`` ×1.25 (so some exceed 100), null when id%5 == 0.
    The source delivers every ``error`` event twice (whole-row duplicates
    for the de-duplication step): a UNION ALL over the whole table.
    """
    ev = table(spark, sf_dir, "events")
    e = ev.unionByName(ev.filter(F.col("event_type") == "error"))
    i = F.col("event_id")
    day = F.col("ts").cast("date")
    fecha = (F.when(i % 29 == 0, F.lit(None).cast("string"))
             .when(i % 23 == 0, F.date_format(day, "yyyy/MM/dd"))
             .when(i % 31 == 0, F.date_format(day, "dd-MM-yyyy"))
             .otherwise(F.date_format(day, "yyyy-MM-dd")))
    producto = F.when(i % 37 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    cantidad = (F.when(i % 13 == 0, F.lit(None).cast("string"))
                .when(i % 11 == 0, F.lit("dos"))
                .when(i % 17 == 0, F.lit("0"))
                .when(i % 19 == 0, F.lit("600"))
                .otherwise((F.pmod("user_id", F.lit(9)) + 1).cast("string")))
    price_txt = F.col("value").cast("decimal(12,2)").cast("string")
    precio = (F.when(i % 7 == 0, F.lit("abc"))
              .when(i % 43 == 0, F.concat(F.lit("-"), price_txt))
              .when(i % 47 == 0, F.lit("0"))
              .otherwise(price_txt))
    cities = F.array(*[F.lit(c) for c in CITIES])
    ciudad = (F.when(i % 53 == 0, F.lit(None).cast("string"))
              .when(i % 59 == 0, F.lit(""))
              .otherwise(F.element_at(cities, (F.pmod("user_id", F.lit(len(CITIES))) + 1).cast("int"))))
    k = F.get_json_object("props", "$.k").cast("double")
    descuento = F.when(i % 5 == 0, F.lit(None).cast("double")).otherwise(k * 1.25)
    return e.select(
        i.alias("id"), fecha.alias("fecha"), producto.alias("producto"),
        cantidad.alias("cantidad"), precio.alias("precio"), ciudad.alias("ciudad"),
        descuento.alias("descuento"),
    )


# ---------------------------------------------------------------------------
# churn portfolio
# ---------------------------------------------------------------------------

FEATURES = ["edad", "anos_cliente", "uso_datos_gb", "llamadas_mes", "reclamos", "plan_premium"]
TARGET = "abandona"


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriber portfolio (clientes) from ``customer`` ⋈ per-customer order aggregates.

    edad = 18 + (custkey*7 mod 52); anos_cliente = whole years between first and
    last order; uso_datos_gb = spend/50000; llamadas_mes = orders;
    reclamos = urgent orders; plan_premium = AUTOMOBILE segment; abandona = no
    order in the last 365 days of the data (customers without orders churned).

    The aggregate is a partial (map-side) hash aggregate keyed by customer, and
    the data end date is one scalar subquery; no window over raw rows.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    per = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        # exact decimal sum: the same double in every engine and partitioning
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    # data end date as a scalar subquery (one tiny aggregate, no join)
    data_end = o.agg(F.max("o_orderdate").cast("date")).scalar()
    j = c.join(per, c.c_custkey == per.o_custkey, "left")
    years = F.floor(F.datediff(F.col("last_order").cast("date"), F.col("first_order").cast("date")) / 365)
    churned = F.col("last_order").isNull() | (F.col("last_order").cast("date") < F.date_sub(data_end, 365))
    return j.select(
        F.col("c_custkey").alias("cliente_id"),
        (F.lit(18) + F.pmod(F.col("c_custkey") * 7, F.lit(52))).cast("int").alias(
            "edad", metadata={"sensible": True, "desc": "edad del titular (años)"}),
        F.coalesce(years, F.lit(0)).cast("int").alias("anos_cliente"),
        (F.coalesce(F.col("spend"), F.lit(0.0)) / 50000).alias("uso_datos_gb"),
        F.coalesce(F.col("n_orders"), F.lit(0)).cast("int").alias("llamadas_mes"),
        F.coalesce(F.col("urgent"), F.lit(0)).cast("int").alias("reclamos"),
        (F.col("c_mktsegment") == "AUTOMOBILE").cast("int").alias("plan_premium"),
        churned.cast("int").alias(TARGET),
    )


def portfolio_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio as measured by a source that writes NaN where it knows nothing: every ninth customer's use."""
    use = F.when(F.col("cliente_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("uso_datos_gb"))
    return portfolio(spark, sf_dir).withColumn("uso_datos_gb", use)


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic (label, score) pairs for the metric operators, from ``lineitem``.

    label = returned line (l_returnflag = 'R'); score = l_discount*10 in [0,1]
    (11 distinct values, so ties are the common case); pred = score >= 0.5.
    """
    li = table(spark, sf_dir, "lineitem")
    score = F.col("l_discount") * 10
    return li.select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("pred"),
    )


def negotiations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negotiation rounds (negociaciones) from all turns of ``conversations``.

    Each conversation is one negotiation over quote ``conv_id``; round
    floor(turn / 2) + 1 pairs the mail sent (the buyer's 'user' turn) with the
    mail received (the 'assistant' turn).  The pairing is a grouped aggregate.
    """
    c = table(spark, sf_dir, "conversations")
    ronda = (F.floor(F.col("turn") / 2) + 1).cast("int")
    sent = F.min(F.when(F.col("role") == "user", F.col("text")))
    received = F.min(F.when(F.col("role") == "assistant", F.col("text")))
    return (c.groupBy(F.col("conv_id").alias("cotizacion_id"), ronda.alias("ronda"))
            .agg(sent.alias("email_enviado"), received.alias("email_recibido"))
            .select((F.col("cotizacion_id") * 100000 + F.col("ronda")).alias("id"), "cotizacion_id", "ronda",
                    "email_enviado", "email_recibido"))
