"""Churn ML queries and profile scoring (§2.1 src_profiles, §2.2 val_profile).

Model fits are not SQL-expressible: those queries have no oracle entry and
are checked by tests on ranges and metric floors.  The split, fold
assignment, standardisation statistics and profile rules are SQL and are
oracle-checked.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from cauce.operators import churn as C
from cauce.operators import newton as N
from cauce.operators import quality as Q
from cauce.plans.registry import register
from cauce.sources import tables as T

_M = C._LEHMER_M
_A = C._LEHMER_A


def _u_sql(key: str, seed: int, a: int = _A) -> str:
    return f"(((({key} * {a} + {seed}) % {_M}) * {a}) % {_M}) / {float(_M)}"


@register("ml_split", f"""
SELECT abandona, {_u_sql('cliente_id', C.SEED)} < {C.TEST_FRACTION} AS es_test, count(*) AS n
FROM portfolio GROUP BY 1, 2""", views=("portfolio",))
def ml_split(spark, d):
    s = C.stratified_split(T.portfolio(spark, d), "cliente_id", T.TARGET)
    return s.groupBy(T.TARGET, "es_test").agg(F.count(F.lit(1)).alias("n"))


@register("ml_folds", f"""
SELECT CAST(floor({_u_sql('cliente_id', C.FOLD_SEED, C._LEHMER_FOLD_A)} * {C.N_FOLDS}) AS INTEGER) AS fold, abandona, count(*) AS n
FROM portfolio WHERE NOT ({_u_sql('cliente_id', C.SEED)} < {C.TEST_FRACTION}) GROUP BY 1, 2""",
          views=("portfolio",))
def ml_folds(spark, d):
    s = C.stratified_split(T.portfolio(spark, d), "cliente_id", T.TARGET).filter(~F.col("es_test"))
    s = C.with_folds(s, "cliente_id")
    return s.groupBy("fold", T.TARGET).agg(F.count(F.lit(1)).alias("n"))


@register("ml_standardize", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS columna, round(avg(CAST({c} AS DOUBLE)), 6) AS media, round(stddev_pop(CAST({c} AS DOUBLE)), 6) AS std
FROM portfolio WHERE NOT ({_u_sql('cliente_id', C.SEED)} < {C.TEST_FRACTION})""" for c in T.FEATURES),
          views=("portfolio",))
def ml_standardize(spark, d):
    s = C.stratified_split(T.portfolio(spark, d), "cliente_id", T.TARGET)
    _, _, params = C.standardize(s.filter(~F.col("es_test")), None, T.FEATURES)
    rows = [(c, round(m, 6), round(sd, 6)) for c, (m, sd) in params.items()]
    return spark.createDataFrame(rows, "columna string, media double, std double")


# --- profiles (incoming customer profiles under field constraints) ---------

# FIXED VALUES — field constraints of a submitted profile.
PROFILE_RULES = {
    "edad": (18, 99), "anos_cliente": (0, None), "uso_datos_gb": (0, None),
    "llamadas_mes": (0, None), "reclamos": (0, None), "plan_premium": (0, 1),
}


def profile_flags():
    out = {}
    for c, (lo, hi) in PROFILE_RULES.items():
        cond = F.col(c).isNotNull() & (F.col(c) >= lo)
        if hi is not None:
            cond = cond & (F.col(c) <= hi)
        out[f"ok_{c}"] = F.coalesce(cond, F.lit(False))
    return out


def _profiles(spark, d):
    """Profiles as submitted: the portfolio features with the tenure shifted
    so that new customers arrive with a negative value (a real input error)."""
    p = T.portfolio(spark, d)
    return p.select("cliente_id", *[F.col(c) for c in T.FEATURES if c != "anos_cliente"],
                    (F.col("anos_cliente") - 1).alias("anos_cliente"))


_PROFILE_SQL_COND = " AND ".join(
    f"coalesce({c} >= {lo}" + (f" AND {c} <= {hi}" if hi is not None else "") + ", false)"
    for c, (lo, hi) in PROFILE_RULES.items())
_PROFILES_SQL = ("profiles AS (SELECT cliente_id, edad, uso_datos_gb, llamadas_mes, reclamos, plan_premium, "
                 "anos_cliente - 1 AS anos_cliente FROM portfolio)")


@register("src_profiles", f"WITH {_PROFILES_SQL} SELECT * FROM profiles", views=("portfolio",))
def src_profiles(spark, d):
    return _profiles(spark, d)


@register("val_profile", f"""
WITH {_PROFILES_SQL} SELECT cliente_id, {_PROFILE_SQL_COND} AS perfil_valido FROM profiles""",
          views=("portfolio",))
def val_profile(spark, d):
    p = _profiles(spark, d).withColumns(profile_flags())
    ok = F.lit(True)
    for c in PROFILE_RULES:
        ok = ok & F.col(f"ok_{c}")
    return p.select("cliente_id", ok.alias("perfil_valido"))


# --- model training and scoring (no oracle) --------------------------------

_CACHE: dict = {}


def trained(spark, d):
    """The candidates trained on the portfolio at ``d``, the best picked.

    Trained once per session and content: every call reads the portfolio and
    compares its row count and hash, so changed data are trained anew.
    """
    p = T.portfolio(spark, d).persist(StorageLevel.MEMORY_AND_DISK)  # derived once, to compare and to train
    try:
        mark = tuple(p.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*p.columns).cast("decimal(38,0)"))).first())
        key = (spark.sparkContext.applicationId, mark)
        if key not in _CACHE:
            _CACHE.clear()
            _CACHE[key] = C.train_and_select(p, T.FEATURES, T.TARGET, "cliente_id")
        return _CACHE[key]
    finally:
        p.unpersist()


def _score(spark, d, rows):
    t = trained(spark, d)
    return C.score(rows, t["best_model"], T.FEATURES, t["params"], t["scaled"], t["fills"])


_TRAIN = f"NOT ({_u_sql('cliente_id', C.SEED)} < {C.TEST_FRACTION})"
# the portfolio as it arrives: every eleventh customer's data use and every seventh's complaints are unknown
_GAPS = {"uso_datos_gb": 11, "reclamos": 7}
_GAP_COLS = ", ".join(f"CASE WHEN cliente_id % {_GAPS[c]} = 0 THEN NULL ELSE {c} END AS {c}" if c in _GAPS else c
                      for c in T.FEATURES)
_FILLED = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM gaps WHERE {_TRAIN})) AS {c}"
                    if c in _GAPS else c for c in T.FEATURES)
_PREP_STATS = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                        for c in T.FEATURES)


@register("ml_prepare", f"""
WITH gaps AS (SELECT cliente_id, {T.TARGET}, {_GAP_COLS} FROM portfolio),
filled AS (SELECT cliente_id, {T.TARGET}, {_FILLED} FROM gaps),
st AS (SELECT {_PREP_STATS} FROM filled WHERE {_TRAIN})
SELECT cliente_id, {_u_sql('cliente_id', C.SEED)} < {C.TEST_FRACTION} AS es_test, {T.TARGET},
  {", ".join(f"round(CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END, 6) AS {c}_esc"
             for c in T.FEATURES)}
FROM filled, st""", views=("portfolio",))
def ml_prepare(spark, d):
    """Split, then impute and standardise with the train split's statistics (D9)."""
    p = T.portfolio(spark, d).withColumns({
        c: F.when(F.col("cliente_id") % n != 0, F.col(c)) for c, n in _GAPS.items()})
    s = C.stratified_split(p, "cliente_id", T.TARGET)
    filled = Q.apply_imputation(s, Q.fit_imputation(s.filter(~F.col("es_test")).select(*T.FEATURES)))
    train, test, _ = C.standardize(filled.filter(~F.col("es_test")), filled.filter(F.col("es_test")), T.FEATURES)
    both = train.unionByName(test)
    return both.select("cliente_id", "es_test", T.TARGET,
                       *[F.round(f"{c}_esc", 6).alias(f"{c}_esc") for c in T.FEATURES])


def _model_query(name):
    def q(spark, d):
        r = trained(spark, d)["results"][name]
        m = r["metrics"]
        return spark.createDataFrame(
            [(name, float(m["accuracy"]), float(m["precision"]), float(m["recall"]), float(m["f1"]),
              float(m["roc_auc"]), float(m["gini"]))],
            "modelo string, accuracy double, precision double, recall double, f1 double, roc_auc double, "
            "gini double")
    return q


for _qid, _name in {"ml_logreg": "Regresión Logística", "ml_tree": "Árbol de Decisión",
                    "ml_forest": "Random Forest", "ml_gbt": "Gradient Boosting"}.items():
    register(_qid)(_model_query(_name))


_STEP = [0.01 * (i + 1) for i in range(len(T.FEATURES) + 1)]


def _newton_sql():
    xs = [f"CAST({c} AS DOUBLE)" for c in T.FEATURES] + ["1.0"]
    z = " + ".join(f"{x} * {b!r}" for x, b in zip(xs, (-b / 10 for b in _STEP)))
    n = len(xs)
    rows = [f"SELECT 'h' AS suma, {i} AS i, {j} AS j, round(sum(p * (1 - p) * x{i} * x{j}), 3) AS valor FROM t"
            for i in range(n) for j in range(i, n)]
    rows += [f"SELECT 'g', {i}, {i}, round(sum((p - y) * x{i}), 3) FROM t" for i in range(n)]
    cols = ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs))
    return (f"WITH t AS (SELECT {cols}, CAST(abandona AS DOUBLE) AS y, 1.0 / (1.0 + exp(-({z}))) AS p FROM portfolio)\n"
            + "\nUNION ALL\n".join(rows))


@register("ml_logreg_step", _newton_sql(), views=("portfolio",))
def ml_logreg_step(spark, d):
    """The sums of one Newton step of the logistic regression, at given coefficients."""
    found = N.step_statistics(T.portfolio(spark, d), T.FEATURES, [-b / 10 for b in _STEP], T.TARGET)
    n = len(T.FEATURES) + 1
    cells = [("h", i, j, f"h_{i}_{j}") for i in range(n) for j in range(i, n)] + [("g", i, i, f"g_{i}") for i in range(n)]
    return found.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("suma"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(c, 3).alias("valor"))
        for k, i, j, c in cells])).alias("s")).select("s.*")


@register("ml_evaluate")
def ml_evaluate(spark, d):
    return C.model_table(trained(spark, d)["results"])


@register("agg_model_table_ml")
def agg_model_table_ml(spark, d):
    return C.model_table(trained(spark, d)["results"]).drop("tiempo_entrenamiento_s")


@register("ml_best_model")
def ml_best_model(spark, d):
    return C.select_best(C.model_table(trained(spark, d)["results"]))


@register("ml_importance")
def ml_importance(spark, d):
    t = trained(spark, d)
    return C.importances(t["best_model"], t["feature_cols"])


@register("sort_importance")
def sort_importance(spark, d):
    """Importances with their rank, largest first (names break ties)."""
    t = trained(spark, d)
    rows = C.importances(t["best_model"], t["feature_cols"])
    rank = F.row_number().over(Window.orderBy(F.desc("importancia"), "variable"))  # one row per feature
    return rows.select(rank.alias("puesto"), "variable", "importancia").orderBy("puesto")


@register("ml_confusion_best")
def ml_confusion_best(spark, d):
    return trained(spark, d)["confusion"]


@register("ml_score")
def ml_score(spark, d):
    return _score(spark, d, T.portfolio(spark, d))


@register("ml_score_batch")
def ml_score_batch(spark, d):
    """Impute with the train statistics → score → segment summary."""
    s = _score(spark, d, T.portfolio(spark, d))
    return s.groupBy("segmento_riesgo").agg(F.count(F.lit(1)).alias("clientes"))


@register("ml_score_profiles")
def ml_score_profiles(spark, d):
    """Valid submitted profiles scored; invalid ones are quarantined (not scored)."""
    p = _profiles(spark, d).withColumns(profile_flags())
    ok = F.lit(True)
    for c in PROFILE_RULES:
        ok = ok & F.col(f"ok_{c}")
    good = p.filter(ok).select("cliente_id", *T.FEATURES)
    return _score(spark, d, good)


@register("top_risk_scored")
def top_risk_scored(spark, d):
    s = _score(spark, d, T.portfolio(spark, d))
    cols = ["edad", "anos_cliente", "reclamos", "plan_premium", "prob_abandono", "segmento_riesgo",
            "accion_retencion"]
    return s.orderBy(F.desc("prob_abandono"), "cliente_id").limit(5).select(*cols)


@register("ml_grid")
def ml_grid(spark, d):
    """Random-forest grid (3×4×3) with 5 stratified folds, recall of class 1; no other model is trained."""
    data = C.prepare(T.portfolio(spark, d), T.FEATURES, T.TARGET, "cliente_id")
    return C.tune_forest(data, T.FEATURES, "cliente_id")[1]


@register("ml_tuned_forest")
def ml_tuned_forest(spark, d):
    """The grid's refitted forest evaluated on the test split, and the
    selection over all five candidates (recall, then F1, first listed)."""
    t = C.train_and_select(T.portfolio(spark, d), T.FEATURES, T.TARGET, "cliente_id", with_grid=True)
    table = C.model_table(t["results"]).drop("tiempo_entrenamiento_s")
    return table.withColumn("seleccionado", F.col("modelo") == F.lit(t["best_name"]))


def _exact_split_sql():
    u = _u_sql("cliente_id", C.SEED)
    return f"""
WITH c AS (SELECT abandona, count(*) AS k FROM portfolio GROUP BY abandona),
t AS (SELECT CAST(ceil({C.TEST_FRACTION} * (SELECT sum(k) FROM c) - 1e-9) AS BIGINT) AS n_test,
             (SELECT sum(k) FROM c) AS n),
a AS (SELECT c.abandona, c.k, (t.n_test * c.k) // t.n AS base, (t.n_test * c.k) % t.n AS rem, t.n_test FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, CAST(abandona AS VARCHAR)) AS pos,
             n_test - sum(base) OVER () AS extra FROM a),
q AS (SELECT abandona, base + CASE WHEN pos <= extra THEN 1 ELSE 0 END AS quota FROM r),
ranked AS (SELECT p.abandona, row_number() OVER (PARTITION BY p.abandona ORDER BY {u}) AS rk FROM portfolio p)
SELECT ranked.abandona, rk <= quota AS es_test, count(*) AS n
FROM ranked JOIN q ON ranked.abandona = q.abandona GROUP BY 1, 2"""


@register("ml_split_exact", _exact_split_sql(), views=("portfolio",))
def ml_split_exact(spark, d):
    """Exact-size stratified split (per-class quotas, smallest draws first)."""
    s = C.stratified_split(T.portfolio(spark, d), "cliente_id", T.TARGET, exact=True)
    return s.groupBy(T.TARGET, "es_test").agg(F.count(F.lit(1)).alias("n"))
