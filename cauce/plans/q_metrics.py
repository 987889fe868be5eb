"""Classification metric and chart-aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import metrics as M
from cauce.plans import oracle as O
from cauce.plans.registry import register
from cauce.sources import tables as T

_CONF = """count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp"""

_SAFE = "coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def _metrics_sql(src="scored_lines"):
    return f"""SELECT round({_SAFE.format(a='tp + tn', b='tp + tn + fp + fn')}, 4) AS accuracy,
  round({_SAFE.format(a='tp', b='tp + fp')}, 4) AS precision,
  round({_SAFE.format(a='tp', b='tp + fn')}, 4) AS recall,
  round({_SAFE.format(a='2 * tp', b='2 * tp + fp + fn')}, 4) AS f1
FROM (SELECT {_CONF} FROM {src}) c"""


_AUC_CTE = """
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM scored_lines GROUP BY score),
c AS (SELECT score, pos, neg,
        coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
        coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below
      FROM g),
a AS (SELECT CAST(2 * sum(CAST(pos AS HUGEINT) * neg_below) + sum(CAST(pos AS HUGEINT) * neg) AS DOUBLE)
             / (2 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM c)"""


def _lines(spark, d):
    return T.scored_lines(spark, d)


@register("agg_confusion", f"SELECT {_CONF} FROM scored_lines", views=("scored_lines",))
def agg_confusion(spark, d):
    return M.confusion(_lines(spark, d))


@register("agg_class_metrics", _metrics_sql(), views=("scored_lines",))
def agg_class_metrics(spark, d):
    return M.class_metrics(_lines(spark, d))


@register("agg_auc_gini", f"WITH {_AUC_CTE} SELECT round(auc, 4) AS roc_auc, round(2 * auc - 1, 4) AS gini FROM a",
          views=("scored_lines",))
def agg_auc_gini(spark, d):
    return M.auc_gini(_lines(spark, d))


@register("agg_roc_points", f"""
WITH {_AUC_CTE}
SELECT score AS umbral,
  ((SELECT sum(neg) FROM g) - neg_below) / CAST((SELECT sum(neg) FROM g) AS DOUBLE) AS fpr,
  ((SELECT sum(pos) FROM g) - pos_below) / CAST((SELECT sum(pos) FROM g) AS DOUBLE) AS tpr,
  CAST((SELECT sum(pos) FROM g) - pos_below AS BIGINT) AS tp,
  CAST((SELECT sum(neg) FROM g) - neg_below AS BIGINT) AS fp
FROM c UNION ALL SELECT NULL, 0.0, 0.0, 0, 0""", views=("scored_lines",))
def agg_roc_points(spark, d):
    return M.roc_points(_lines(spark, d))


@register("win_cumulative", f"""
WITH {_AUC_CTE}
SELECT score AS umbral, CAST((SELECT sum(pos) FROM g) - pos_below AS BIGINT) AS tp,
  CAST((SELECT sum(neg) FROM g) - neg_below AS BIGINT) AS fp
FROM c UNION ALL SELECT NULL, 0, 0""", views=("scored_lines",))
def win_cumulative(spark, d):
    return M.roc_points(_lines(spark, d)).select("umbral", "tp", "fp")


@register("agg_class_report", f"""
WITH c AS (SELECT {_CONF} FROM scored_lines),
p AS (
  SELECT '0' AS clase, {_SAFE.format(a='tn', b='tn + fn')} AS precision, {_SAFE.format(a='tn', b='tn + fp')} AS recall,
    {_SAFE.format(a='2 * tn', b='2 * tn + fn + fp')} AS f1, CAST(tn + fp AS DOUBLE) AS support FROM c
  UNION ALL
  SELECT '1', {_SAFE.format(a='tp', b='tp + fp')}, {_SAFE.format(a='tp', b='tp + fn')},
    {_SAFE.format(a='2 * tp', b='2 * tp + fp + fn')}, CAST(tp + fn AS DOUBLE) FROM c),
al AS (
  SELECT * FROM p
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM p
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM p)
SELECT clase, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM al""",
          views=("scored_lines",))
def agg_class_report(spark, d):
    return M.class_report(_lines(spark, d))


# three threshold classifiers on the same score, compared like the model table
THRESHOLDS = {"umbral_0.3": 0.3, "umbral_0.5": 0.5, "umbral_0.7": 0.7}


def _model_rows(spark, d):
    return M.threshold_table(_lines(spark, d), THRESHOLDS)


def _model_sql():
    parts = []
    for i, (name, t) in enumerate(THRESHOLDS.items()):
        src = f"(SELECT label, CAST(score >= {t} AS INTEGER) AS pred FROM scored_lines)"
        parts.append(f"SELECT '{name}' AS modelo, {i} AS orden, * FROM ({_metrics_sql(src)})")
    return (f"WITH {_AUC_CTE}, t AS ({' UNION ALL '.join(parts)})\n"
            "SELECT t.*, round(a.auc, 4) AS roc_auc, round(2 * a.auc - 1, 4) AS gini FROM t, a")


@register("agg_model_table", _model_sql(), views=("scored_lines",))
def agg_model_table(spark, d):
    return _model_rows(spark, d)


@register("best_model", "SELECT modelo, recall, f1 FROM (" + _model_sql()
          + ") m ORDER BY recall DESC, f1 DESC, orden LIMIT 1", views=("scored_lines",))
def best_model(spark, d):
    t = _model_rows(spark, d)
    return t.orderBy(F.desc("recall"), F.desc("f1"), F.asc("orden")).limit(1).select("modelo", "recall", "f1")


@register("agg_correlation", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + ("1.0 AS corr" if a == b else
       f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS corr FROM portfolio_gaps")
    for a in T.FEATURES + [T.TARGET] for b in T.FEATURES + [T.TARGET]),
    views=("portfolio_gaps",))
def agg_correlation(spark, d):
    return M.correlation(T.portfolio_gaps(spark, d), T.FEATURES + [T.TARGET])


@register("agg_histogram", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS columna, b AS bin, count(*) AS n FROM (
  SELECT CAST(CASE WHEN s.hi = s.lo THEN 0 ELSE least(floor((CAST({c} AS DOUBLE) - s.lo) / (s.hi - s.lo) * 20), 19) END
    AS INTEGER) AS b
  FROM portfolio_gaps, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM portfolio_gaps) s
  WHERE {c} IS NOT NULL) t GROUP BY b""" for c in T.FEATURES), views=("portfolio_gaps",))
def agg_histogram(spark, d):
    return M.histogram(T.portfolio_gaps(spark, d), T.FEATURES)


@register("agg_feature_means", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS columna, round(avg(CAST({c} AS DOUBLE)), 4) AS media FROM portfolio" for c in T.FEATURES),
    views=("portfolio",))
def agg_feature_means(spark, d):
    return M.column_means(T.portfolio(spark, d), T.FEATURES)


def _box_sql():
    parts = []
    for c in T.FEATURES:
        parts.append(f"""
SELECT '{c}' AS columna, CAST(abandona AS VARCHAR) AS clase,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS mediana,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
FROM portfolio_gaps GROUP BY abandona""")
    return f"""
WITH q AS ({" UNION ALL ".join(parts)}),
lim AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lim_inf, q3 + 1.5 * (q3 - q1) AS lim_sup FROM q),
long AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS columna, CAST(abandona AS VARCHAR) AS clase, CAST({c} AS DOUBLE) AS v FROM portfolio_gaps"
        for c in T.FEATURES)})
SELECT l.columna, l.clase, q1, mediana, q3,
  min(CASE WHEN v >= lim_inf AND v <= lim_sup THEN v END) AS bigote_inf,
  max(CASE WHEN v >= lim_inf AND v <= lim_sup THEN v END) AS bigote_sup,
  count(*) FILTER (WHERE NOT (v >= lim_inf AND v <= lim_sup)) AS atipicos
FROM long l JOIN lim ON l.columna = lim.columna AND l.clase = lim.clase
GROUP BY l.columna, l.clase, q1, mediana, q3"""


@register("agg_boxplot", _box_sql(), views=("portfolio_gaps",))
def agg_boxplot(spark, d):
    return M.boxplot(T.portfolio_gaps(spark, d), T.FEATURES, T.TARGET)


# --- churn rules on a probability column -----------------------------------

@register("segment_risk", f"""
SELECT {O.sql_segment('score')} AS segmento_riesgo, count(*) AS n FROM scored_lines GROUP BY 1""",
          views=("scored_lines",))
def segment_risk(spark, d):
    s = _lines(spark, d).select(R.risk_segment("score").alias("segmento_riesgo"))
    return s.groupBy("segmento_riesgo").agg(F.count(F.lit(1)).alias("n"))


@register("map_action", f"""
SELECT {O.sql_segment('score')} AS segmento_riesgo, {O.sql_action(O.sql_segment('score'))} AS accion_retencion,
  count(*) AS n FROM scored_lines GROUP BY 1, 2""", views=("scored_lines",))
def map_action(spark, d):
    s = _lines(spark, d).select(R.risk_segment("score").alias("segmento_riesgo"))
    s = s.withColumn("accion_retencion", R.retention_action("segmento_riesgo"))
    return s.groupBy("segmento_riesgo", "accion_retencion").agg(F.count(F.lit(1)).alias("n"))


@register("round_prob", """
SELECT round(score * 0.987654321, 4) AS prob_abandono, count(*) AS n FROM scored_lines GROUP BY 1""",
          views=("scored_lines",))
def round_prob(spark, d):
    p = _lines(spark, d).select(F.round(F.col("score") * 0.987654321, 4).alias("prob_abandono"))
    return p.groupBy("prob_abandono").agg(F.count(F.lit(1)).alias("n"))


@register("flag_at_risk", f"""
SELECT score >= {R.AT_RISK_THRESHOLD} AS en_riesgo, count(*) AS n FROM scored_lines GROUP BY 1""",
          views=("scored_lines",))
def flag_at_risk(spark, d):
    s = _lines(spark, d).select(R.at_risk_flag("score").alias("en_riesgo"))
    return s.groupBy("en_riesgo").agg(F.count(F.lit(1)).alias("n"))


@register("agg_value_counts", f"""
SELECT {O.sql_segment('score')} AS segmento_riesgo, count(*) AS n FROM scored_lines
WHERE {O.sql_segment('score')} IS NOT NULL GROUP BY 1""", views=("scored_lines",))
def agg_value_counts(spark, d):
    from cauce.operators.procurement import value_counts
    return value_counts(_lines(spark, d).select(R.risk_segment("score").alias("segmento_riesgo")),
                        "segmento_riesgo")


@register("agg_high_risk_rate", f"""
SELECT count(*) FILTER (WHERE {O.sql_segment('score')} = 'ALTO') AS clientes_alto_riesgo,
  round(count(*) FILTER (WHERE {O.sql_segment('score')} = 'ALTO') / CAST(greatest(count(*), 1) AS DOUBLE) * 100, 2)
    AS tasa_riesgo_alto
FROM scored_lines""", views=("scored_lines",))
def agg_high_risk_rate(spark, d):
    from cauce.operators.kpi import high_risk
    return high_risk(_lines(spark, d).select(R.risk_segment("score").alias("segmento_riesgo")))


@register("top_risk", f"""
SELECT id, label, score AS prob_abandono, {O.sql_segment('score')} AS segmento_riesgo,
  {O.sql_action(O.sql_segment('score'))} AS accion_retencion
FROM scored_lines ORDER BY score DESC, id, label LIMIT 5""", views=("scored_lines",))
def top_risk(spark, d):
    s = _lines(spark, d).select("id", "label", F.col("score").alias("prob_abandono"),
                                R.risk_segment("score").alias("segmento_riesgo"))
    s = s.withColumn("accion_retencion", R.retention_action("segmento_riesgo"))
    return s.orderBy(F.desc("prob_abandono"), "id", "label").limit(5)
