"""Churn modelling on Spark ML: split, weights, scaling, four models, tuning,
evaluation, importances, scoring and segmentation.

Fitting is distributed by Spark ML (tree learners aggregate histograms
per partition; logistic regression runs L-BFGS over partitioned gradients).
Metrics reuse the exact aggregates of ``cauce.operators.metrics``.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassifier, LogisticRegressionModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.functions import rules as R
from cauce.operators import forest as FO
from cauce.operators import metrics as M
from cauce.operators.newton import NewtonLogisticRegression, logistic, margin
from cauce.session import ensure_checkpoint_dir

SEED = 42
TEST_FRACTION = 0.2
N_FOLDS = 5
FOLD_SEED = 7
# FIXED VALUES — random-forest grid searched by the reference.
GRID_TREES = [100, 200, 300]
GRID_DEPTH = [4, 6, 8, None]
GRID_MIN_LEAF = [1, 2, 4]
SPARK_MAX_DEPTH = 30  # "no limit" in the reference; Spark trees stop at depth 30
# Lehmer generator constants (a deterministic per-key uniform in [0,1),
# expressible in SQL so the split can be checked by an oracle).
_LEHMER_A = 48271
_LEHMER_FOLD_A = 16807  # a different multiplier: folds independent of the split
_LEHMER_M = 2147483647


def split_uniform(key, seed: int = SEED, a: int = _LEHMER_A):
    """Deterministic pseudo-uniform in [0,1) from an integer key and a seed."""
    k = F.col(key) if isinstance(key, str) else key
    # the key is reduced first, so that no key overflows
    x = F.pmod(F.pmod(k, F.lit(_LEHMER_M)).cast("bigint") * a + F.lit(seed), F.lit(_LEHMER_M))
    x = F.pmod(x * a, F.lit(_LEHMER_M))
    return x / F.lit(float(_LEHMER_M))


def key_number(df: DataFrame, key: str) -> F.Column:
    """The key as an integer: itself, or its 64-bit hash when it is not an integer."""
    integral = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.col(key) if integral else F.xxhash64(key)


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per non-null class; more than MAX_CLASSES classes are an error."""
    rows = (df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
            .limit(M.MAX_CLASSES + 1).collect())
    if len(rows) > M.MAX_CLASSES:
        raise ValueError(f"{target} has more than {M.MAX_CLASSES} classes")
    return {r[0]: r[1] for r in rows}


def stratified_split(df: DataFrame, key: str, target: str, test_fraction: float = TEST_FRACTION,
                     seed: int = SEED, exact: bool = False) -> DataFrame:
    """Add ``es_test``.

    Default: a per-row deterministic Bernoulli draw with the same fraction in
    every class (stratified in expectation, like ``sampleBy``) — a pure
    projection: no shuffle, no per-class window, survives recompute.

    ``exact=True``: exact sizes as a stratified train/test split allocates
    them — ceil(fraction·n) test rows shared by class proportionally
    (largest remainders first).  Each class takes its rows with the smallest
    per-key draw; the class's cut-off draw is found by distributed selection
    (bounded driver traffic), so membership stays a per-row predicate.
    Keys must be distinct (the draw is then distinct too).
    """
    u = split_uniform(key_number(df, key), seed)
    if not exact:
        return df.withColumn("es_test", u < test_fraction)
    from cauce.operators.quality import order_statistics
    counts = class_counts(df, target)
    n = sum(counts.values())
    if not n:
        return df.withColumn("es_test", F.lit(False))
    n_test = -(-int(round(test_fraction * n * 1e9)) // int(1e9))  # ceil, robust to float noise
    base = {c: (n_test * k) // n for c, k in counts.items()}
    rest = n_test - sum(base.values())
    order = sorted(counts, key=lambda c: (-((n_test * counts[c]) % n), str(c)))
    for c in order[:rest]:
        base[c] += 1
    long = df.select(F.col(target).cast("string").alias("sid"), u.alias("v"))
    wanted = {str(c): [k - 1] for c, k in base.items() if k > 0}
    cut = order_statistics(long, wanted) if wanted else {}
    conds = [(F.col(target) == c) & (u <= F.lit(cut[(str(c), k - 1)])) for c, k in base.items() if k > 0]
    member = conds[0]
    for cnd in conds[1:]:
        member = member | cnd
    return df.withColumn("es_test", F.coalesce(member, F.lit(False)))


def with_folds(df: DataFrame, key: str, n_folds: int = N_FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """Add ``fold`` in [0, n_folds): a per-key deterministic draw, the same
    distribution in every class (stratified in expectation)."""
    u = split_uniform(key_number(df, key), seed, _LEHMER_FOLD_A)
    return df.withColumn("fold", F.floor(u * n_folds).cast("int"))


ROWS_PER_PARTITION = 10000
#: Partitions of small tables at most; then partitions grow, up to ``MOST_ROWS_PER_PARTITION``.
FEW_PARTITIONS = 24
MOST_ROWS_PER_PARTITION = 100000


def fitting_partitions(n: int) -> int:
    """Partitions to fit ``n`` rows in: a task over a few rows costs more to start than to run, and boosting
    starts some hundred jobs."""
    return max(2, min(-(-n // ROWS_PER_PARTITION), FEW_PARTITIONS), -(-n // MOST_ROWS_PER_PARTITION))


def sized_for_fitting(df: DataFrame, *key: str, partitions=fitting_partitions) -> DataFrame:
    """Training or test rows in :func:`fitting_partitions`, persisted (memory and disk).

    Iterative learners and the metrics run many jobs over the same rows, each with
    a task per partition.  Rows are dealt by a hash of the key, so bagging does not depend
    on the cluster, only on the rows.
    """
    return df.repartition(partitions(df.count()), *key).persist(StorageLevel.MEMORY_AND_DISK)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights n / (k · n_c) per class."""
    counts = df.groupBy(F.col(target).alias("clase")).agg(F.count(F.lit(1)).alias("n"))
    n = df.agg(F.count(F.lit(1))).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    return counts.select("clase", "n", (n / (k * F.col("n"))).alias("peso"))


def with_class_weight(df: DataFrame, target: str, col: str = "peso") -> DataFrame:
    """Attach the balanced class weight to every row (one literal per class, no join)."""
    counts = class_counts(df, target)
    n, weight = sum(counts.values()), F.lit(None).cast("double")
    for c, k in counts.items():
        weight = F.when(F.col(target) == c, F.lit(n / (len(counts) * k))).otherwise(weight)
    return df.withColumn(col, weight)


def standardize(train: DataFrame, other: DataFrame | None, cols) -> tuple[DataFrame, DataFrame | None, dict]:
    """(x − mean) / population std fitted on ``train``; zero variance → 0."""
    st = train.agg(*[F.avg(c).alias(f"{c}__m") for c in cols],
                   *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]).first()
    params = {c: (st[f"{c}__m"], st[f"{c}__s"]) for c in cols}

    def apply(df):
        return df.withColumns({
            f"{c}_esc": F.when(F.lit(params[c][1]) == 0, F.lit(0.0))
            .otherwise((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])) for c in cols})
    return apply(train), (apply(other) if other is not None else None), params


def candidate_models(n_weight: float, features: str = "features", label: str = "label",
                     weight: str = "peso") -> dict:
    """The four candidates of the reference, in its order.

    Logistic regression: sklearn penalises the loss *sum* with C=1 while
    Spark penalises the weighted *mean*, so regParam = 1 / Σw.
    """
    common = dict(featuresCol=features, labelCol=label)
    trees = common  # shallow trees: caching node ids costs more than it saves
    return {
        "Regresión Logística": NewtonLogisticRegression(regParam=1.0 / n_weight, weightCol=weight, **common),
        "Árbol de Decisión": DecisionTreeClassifier(maxDepth=5, weightCol=weight, seed=SEED, **trees),
        "Random Forest": RandomForestClassifier(numTrees=200, maxDepth=6, weightCol=weight, seed=SEED,
                                                **trees),
        "Gradient Boosting": GBTClassifier(maxIter=150, maxDepth=3, stepSize=0.1, seed=SEED, **trees),
    }


def probability_of_churn(scored: DataFrame, col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    """accuracy, precision, recall, f1, roc_auc, gini (4 decimals) in one row."""
    return evaluate_outcomes(outcomes(scored, label))


def outcomes(scored: DataFrame, label: str = "label") -> DataFrame:
    """(label, pred, score) of a model's output."""
    return scored.select(F.col(label).cast("int").alias("label"),
                         F.col("prediction").cast("int").alias("pred"),
                         probability_of_churn(scored).alias("score"))


def evaluate_outcomes(s: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """:func:`evaluate` of :func:`outcomes`; ``groups`` are its ``score_groups`` where they are at hand."""
    auc = M.auc_of_groups(M.score_groups(s) if groups is None else groups).select(F.struct("roc_auc", "gini")).scalar()
    return M.class_metrics(s).select("*", auc["roc_auc"].alias("roc_auc"), auc["gini"].alias("gini"))


def evaluated(model: PipelineModel, test: DataFrame):
    """The row of :func:`evaluate` for ``model`` on ``test``.  The metrics need several passes, the model only one:
    its outcomes are persisted for them, and so are their distinct scores."""
    s = outcomes(model.transform(test)).persist(StorageLevel.MEMORY_AND_DISK)
    groups = M.score_groups(s).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return evaluate_outcomes(s, groups).first()
    finally:
        groups.unpersist()
        s.unpersist()


def assemble(cols, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


#: Binned rows a task of a boosting job takes: its jobs last some 0.1 s, so a task over fewer costs more than it does.
GROUPS_PER_PARTITION = 30000
#: Ranks of a feature's values that the thresholds of boosting's trees are chosen from, evenly spaced over all rows.
BOUND_RANKS = 10000


def thresholds(ranked: list[float], bins: int) -> list[float]:
    """The values between which a tree may cut: those between any two neighbours if there are at most ``bins``
    distinct ones, else those nearest to equal shares of the rows.  ``ranked`` are values in evenly spaced ranks."""
    values, counts = np.unique(np.asarray(ranked, dtype="float64"), return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return middle.tolist()
    below, share, target, out = np.cumsum(counts), len(ranked) / bins, len(ranked) / bins, []
    for m, before, after in zip(middle.tolist(), below[:-1].tolist(), below[1:].tolist()):
        if abs(before - target) < abs(after - target):
            out.append(m)
            target += share
    return out


def bucketizer(rows: DataFrame, features, bins: int) -> Bucketizer:
    """Replaces each feature by its bin (``*_bin``); the bounds come from the ranks of all ``rows``."""
    n = max(1, min(rows.count(), BOUND_RANKS))
    ranks = rows.approxQuantile(list(features), [(i + 0.5) / n for i in range(n)], 0.4 / BOUND_RANKS)
    inf = float("inf")
    # a tree sends the threshold itself to the left, a bucket starts with its lower bound
    bounds = [[-inf, *[math.nextafter(t, inf) for t in thresholds(r, min(bins, n))], inf] for r in ranks]
    return Bucketizer(splitsArray=[b if len(b) > 2 else [-inf, 0.0, inf] for b in bounds], inputCols=list(features),
                      outputCols=[f"{c}_bin" for c in features], handleInvalid="keep")


def fit_boosting(est: GBTClassifier, train: DataFrame, features) -> PipelineModel:
    """``est`` fitted on the distinct binned rows of ``train``, each with its number of rows as weight.

    Trees see nothing of a feature but its bin, so equal binned rows of one class are one row of their summed
    weight, in every round.  Their number is bounded by the bins, not by the rows.  (Only for learners without
    bagging, which would draw the rows of a group together.)
    """
    bins = bucketizer(train, features, est.getMaxBins())
    cols, label = bins.getOutputCols(), est.getLabelCol()
    weight = F.sum(est.getWeightCol()) if est.isSet(est.weightCol) else F.count(F.lit(1)).cast("double")
    # the cast drops the bins' nominal attribute: they are ordered, not categories
    binned = bins.transform(train).withColumns({c: F.col(c).cast("int") for c in cols})
    groups = sized_for_fitting(binned.groupBy(*cols, label).agg(weight.alias("filas")), *cols, label,
                               partitions=lambda n: max(2, -(-n // GROUPS_PER_PARTITION)))
    try:
        vectors = assemble(cols, est.getFeaturesCol())
        model = est.copy({est.weightCol: "filas"}).fit(vectors.transform(groups))
        return PipelineModel(stages=[bins, vectors, model])
    finally:
        groups.unpersist()


def prepare(df: DataFrame, features, target: str, key: str) -> dict:
    """Exact stratified split, then imputation, scaling and class weights fitted on its train part.

    Returns the persisted frames ``train`` and ``test`` (features, ``*_esc``
    columns, ``label``; weights in ``train``), ``fills`` and ``params``.
    """
    from cauce.operators.quality import apply_imputation, fit_imputation
    # the split's quotas and cut-offs take several passes: the table is derived once for all of them
    rows = df.select(key, *features, target)
    # with the same columns as a frame the caller persisted it is that frame, which is the caller's to release
    own = not (rows.storageLevel.useMemory or rows.storageLevel.useDisk)
    if own:
        rows.persist(StorageLevel.MEMORY_AND_DISK)
    split = stratified_split(rows, key, target, exact=True)
    fills = fit_imputation(split.filter(~F.col("es_test")).select(*features))
    filled = apply_imputation(split, fills).withColumn("label", F.col(target).cast("double"))
    train, test, params = standardize(filled.filter(~F.col("es_test")), filled.filter(F.col("es_test")), features)
    train = sized_for_fitting(with_class_weight(train, target), key)
    test = sized_for_fitting(test, key)
    train.count(), test.count()  # both are filled from the table before it is released
    if own:
        rows.unpersist()
    return {"train": train, "test": test, "fills": fills, "params": params}


def train_models(df: DataFrame, features, target: str, key: str, scaled_models=("Regresión Logística",),
                 models: dict | None = None, data: dict | None = None) -> dict:
    """Fit every candidate on the train split and evaluate on the test split.

    Returns {name: {"model": PipelineModel, "metrics": Row, "seconds": float,
    "scaled": bool, "params": dict, "fills": dict}} in the candidates' order.
    ``data`` is a :func:`prepare` result to reuse; ``seconds`` is each fit's
    wall time while sharing the cluster.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        # GBT rounds checkpoint their state there every checkpointInterval
        ensure_checkpoint_dir(spark)
    own = data is None
    data = data or prepare(df, features, target, key)
    train, test = data["train"], data["test"]
    cands = models or candidate_models(train.agg(F.sum("peso")).first()[0])

    def fit(item):
        name, est = item
        scaled = name in scaled_models
        cols = [f"{c}_esc" for c in features] if scaled else list(features)
        t0 = time.perf_counter()
        if isinstance(est, GBTClassifier) and est.getSubsamplingRate() == 1.0:
            model = fit_boosting(est, train, cols)
        else:
            model = Pipeline(stages=[assemble(cols), est]).fit(train)
        secs = time.perf_counter() - t0
        return name, {"model": model, "metrics": evaluated(model, test), "seconds": round(secs, 4),
                      "scaled": scaled, "params": data["params"], "fills": data["fills"]}

    # the candidates are independent: their Spark jobs run concurrently
    # (one driver thread each), so wall time is close to the slowest fit
    with ThreadPoolExecutor(max_workers=max(1, len(cands))) as pool:
        fitted = dict(pool.map(fit, cands.items()))
    if own:
        train.unpersist()
        test.unpersist()
    return {name: fitted[name] for name in cands}  # keep the listing order


def model_table(results: dict) -> DataFrame:
    """models × 6 metrics (and order of listing) as a DataFrame."""
    spark = SparkSession.getActiveSession()
    rows = [(name, i, *[float(r["metrics"][k]) for k in ("accuracy", "precision", "recall", "f1",
                                                          "roc_auc", "gini")], r["seconds"])
            for i, (name, r) in enumerate(results.items())]
    return spark.createDataFrame(rows, "modelo string, orden int, accuracy double, precision double, "
                                       "recall double, f1 double, roc_auc double, gini double, "
                                       "tiempo_entrenamiento_s double")


def select_best(table: DataFrame) -> DataFrame:
    """Highest recall, then F1, first listed on ties."""
    return table.orderBy(F.desc("recall"), F.desc("f1"), F.asc("orden")).limit(1)


def importances(model: PipelineModel, features) -> DataFrame:
    """Tree importances or linear coefficients per feature."""
    spark = SparkSession.getActiveSession()
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficients"):
        vals = est.coefficients.toArray().tolist()
    else:
        vals = [None] * len(features)
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, vals)],
                                 "variable string, importancia double").orderBy(F.desc("importancia"))


#: Nodes up to which a tree is compiled to an expression.
COMPILED_NODES = 127


def compiled_probability(model: PipelineModel, cols: list[str]) -> F.Column | None:
    """The model's probability of class 1 as an expression of its input columns: a linear model as arithmetic, a
    decision tree of at most ``COMPILED_NODES`` nodes as nested conditions.  None for other models.

    It stays inside code generation and needs no vectors, so one profile costs one projection.  As in the fitted
    pipeline a missing input counts as NaN, which is above every threshold.
    """
    est = model.stages[-1]
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols]
    if isinstance(est, LogisticRegressionModel) and est.numClasses == 2:
        return logistic(margin(xs, est.coefficients.toArray(), est.intercept))
    if not isinstance(est, DecisionTreeClassificationModel) or est.numNodes > COMPILED_NODES:
        return None

    def node(n) -> F.Column:
        if n.numDescendants() if callable(getattr(n, "numDescendants", None)) else n.subtreeDepth():
            split = n.split()
            if not hasattr(split, "threshold"):
                raise ValueError("categorical split")
            return F.when(xs[split.featureIndex()] <= F.lit(float(split.threshold())), node(n.leftChild())).otherwise(node(n.rightChild()))
        stats = n.impurityStats().stats()
        total = float(sum(stats))
        return F.lit(float(stats[1]) / total if total else 0.0)

    return node(est._java_obj.rootNode())


def score(df: DataFrame, model: PipelineModel, features, params: dict | None = None,
          scaled: bool = False, fills: dict | None = None) -> DataFrame:
    """Add prob_abandono (4 decimals), segmento_riesgo (unrounded p) and
    accion_retencion; input columns kept.  Missing model columns → error;
    missing values are filled with the train split's statistics (``fills``)."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Faltan columnas requeridas por el modelo: {missing}")
    x = df
    if fills:
        from cauce.operators.quality import apply_imputation
        x = apply_imputation(df, {c: v for c, v in fills.items() if c in features})
    if scaled and params:
        x = x.withColumns({f"{c}_esc": F.when(F.lit(params[c][1]) == 0, F.lit(0.0))
                           .otherwise((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1]))
                           for c in features})
    cols = [f"{c}_esc" for c in features] if scaled and params else list(features)
    compiled = compiled_probability(model, cols)
    s = model.transform(x) if compiled is None else x.withColumn("_p", compiled)
    p = probability_of_churn(s) if compiled is None else F.col("_p")
    keep = df.columns
    return s.select(*keep, F.round(p, 4).alias("prob_abandono"),
                    R.risk_segment(p).alias("segmento_riesgo")).withColumn(
        "accion_retencion", R.retention_action("segmento_riesgo"))


def save_model(model: PipelineModel, path: str, features=None, params: dict | None = None, scaled: bool = False,
               fills: dict | None = None) -> None:
    """The pipeline and, beside it, what rows need before it (train statistics), as one JSON row."""
    model.write().overwrite().save(f"{path}/pipeline")
    prep = json.dumps({"features": list(features or []), "params": params or {}, "scaled": scaled, "fills": fills or {}})
    spark = SparkSession.getActiveSession()
    spark.range(1).select(F.lit(prep).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/preparation")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    """(pipeline, keyword arguments for :func:`score`)."""
    prep = json.loads(SparkSession.getActiveSession().read.text(f"{path}/preparation").first()[0])
    prep["params"] = {c: tuple(v) for c, v in prep["params"].items()}
    return PipelineModel.load(f"{path}/pipeline"), prep


# ------------------------------------------------------------------ the grid
def leaf_probabilities(nodes: DataFrame, depths) -> DataFrame:
    """(tree, leaf, p_<i>) from a saved forest's nodes: the probability of class 1 at the leaf's
    ancestor at each depth limit (the leaf itself where it is not deeper).

    A tree grown to a limit is the deeper tree cut there, since trees grow from
    the top.  Leaves are numbered in node order, as ``leafCol`` numbers them.
    """
    def one_tree(rows):
        rows = rows.sort_values("id")
        left, right = rows["leftChild"].tolist(), rows["rightChild"].tolist()
        p = [float(v[1] / sum(v)) if sum(v) else 0.0 for v in rows["impurityStats"]]
        out, todo = [], [(0, 0, {})]
        found = {}
        while todo:
            i, depth, cut = todo.pop()
            cut = {**cut, depth: p[i]} if depth in depths else cut
            if left[i] < 0:
                found[i] = [cut.get(d, p[i]) if d is not None else p[i] for d in depths]
            else:
                todo += [(left[i], depth + 1, cut), (right[i], depth + 1, cut)]
        for leaf, i in enumerate(sorted(found)):
            out.append((int(rows["treeID"].iloc[0]), leaf, *found[i]))
        return pd.DataFrame(out, columns=["tree", "leaf", *[f"p_{k}" for k in range(len(depths))]])

    schema = "tree int, leaf int, " + ", ".join(f"p_{k} double" for k in range(len(depths)))
    flat = nodes.select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats")
    return flat.groupBy("treeID").applyInPandas(one_tree, schema)


def _cell(trees: int, k: int) -> str:
    return f"s_{trees}_{k}"


def _cells() -> list:
    return [(n, k) for n in GRID_TREES for k in range(len(GRID_DEPTH))]


def grid_votes(forest, valid: DataFrame, path: str, first: int = 0) -> DataFrame:
    """(row, label, s_<trees>_<k>): the summed probabilities of class 1 that ``forest`` adds to each point of the
    grid, its trees being those from number ``first`` on.  ``valid`` has a ``row`` number."""
    forest.write().overwrite().save(path)
    table = leaf_probabilities(valid.sparkSession.read.parquet(f"{path}/data"), GRID_DEPTH)
    rows = forest.transform(valid).select("label", "leaf", "row")
    votes = (rows.select("label", "row", F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))
             .withColumn("leaf", F.col("leaf").cast("int")).join(table, ["tree", "leaf"]))
    return votes.groupBy("row", "label").agg(*[
        F.sum(F.when(F.col("tree") + first < n, F.col(f"p_{k}"))).alias(_cell(n, k)) for n, k in _cells()])


def recalls_of_votes(votes: DataFrame) -> dict:
    """{(trees, depth): recall of class 1} of the votes of all parts of a forest."""
    sums = votes.groupBy("row", "label").agg(*[F.sum(_cell(n, k)).alias(_cell(n, k)) for n, k in _cells()])
    positive = F.col("label") == 1
    row = sums.agg(F.count_if(positive).alias("p"), *[
        F.count_if(positive & (F.col(_cell(n, k)) > n / 2)).alias(f"t_{n}_{k}") for n, k in _cells()]).first()
    return {(n, GRID_DEPTH[k]): row[f"t_{n}_{k}"] / row["p"] if row["p"] else 0.0 for n, k in _cells()}


def grid_recalls(forest, valid: DataFrame, path: str) -> dict:
    """{(trees, depth): recall of class 1} of a forest's prefixes and depth cuts on ``valid``."""
    return recalls_of_votes(grid_votes(forest, valid.withColumn("row", F.monotonically_increasing_id()), path))


#: Trees of a grid forest fitted at once: the driver holds the trees of a fit, and one without a depth limit has up
#: to two nodes a row.
GRID_TREES_AT_ONCE = 20


#: Cells (distinct binned rows, by class and fold) up to which every task of the grid holds them all.
GRID_CELLS = 2_000_000


def binned_cells(train: DataFrame, features, weight: str, bins: int) -> DataFrame:
    """The rows per distinct binned row, class, fold and weight (``b_<i>``, ``label``, ``fold``, the weight, ``filas``)."""
    binning = bucketizer(train, features, bins)
    # a missing value counts as NaN, whose bin is above all others
    cols = [F.coalesce(F.col(c), F.lit(float(len(s) - 1))).cast("short").alias(f"b_{i}")
            for i, (c, s) in enumerate(zip(binning.getOutputCols(), binning.getSplitsArray()))]
    keys = [f"b_{i}" for i in range(len(cols))] + ["label", "fold", weight]
    return binning.transform(train).select(*cols, "label", "fold", weight).groupBy(*keys).agg(F.count(F.lit(1)).alias("filas"))


def held_cells(cells: DataFrame, features, weight: str) -> FO.Cells | None:
    """The cells as arrays; None if there are too many for a task to hold, or not one weight for each of two classes."""
    by = {r["label"]: r for r in cells.groupBy("label").agg(
        F.min(weight).alias("w"), F.max(weight).alias("top"), F.count(F.lit(1)).alias("n")).limit(M.MAX_CLASSES + 1).collect()}
    if not by or not set(by) <= {0.0, 1.0} or sum(r["n"] for r in by.values()) > GRID_CELLS or any(
            r["w"] is None or r["w"] <= 0 or r["w"] != r["top"] for r in by.values()):
        return None
    t = cells.select(*[f"b_{i}" for i in range(len(features))], F.col("label").cast("byte"),
                     F.coalesce("fold", F.lit(N_FOLDS)).cast("short").alias("fold"), "filas").toArrow()
    return FO.cells_of([t[f"b_{i}"].to_numpy() for i in range(len(features))], t["label"].to_numpy(), t["fold"].to_numpy(),
                    t["filas"].to_numpy(), N_FOLDS, [by[c]["w"] if c in by else 1.0 for c in (0.0, 1.0)])


def cell_votes(spark: SparkSession, held, parts: list) -> DataFrame:
    """(hoja, fold, row, filas, desde, s_<k>): for every cell with rows of class 1 in ``fold`` the summed probabilities
    of class 1 of some trees, those from number ``desde`` on, at each depth limit.

    ``held`` are the broadcast cells; ``parts`` are (minimum leaf size, fold, first tree, estimator), each grown in a
    task of its own.
    """
    depths, bounds = list(GRID_DEPTH), sorted(GRID_TREES)
    cells_in, grow_part = FO.Cells, FO.grow_part
    todo = [(leaf, fold, first, est.getNumTrees(), est.getMaxDepth(), est.getSeed()) for leaf, fold, first, est in parts]

    def votes(batches):
        for i in (int(i) for b in batches for i in b["id"]):
            leaf, fold, first, trees, deepest, seed = todo[i]
            cells = cells_in(*held.value)
            rows = cells.rows[1, fold]
            asked = np.flatnonzero(rows)
            if not len(asked):
                continue
            sums: dict = {}
            for at, nodes, ends in grow_part(cells, fold, leaf, deepest, trees, seed, depths, asked):
                for k, end in enumerate(ends):
                    for t, p in enumerate(nodes["p"][end].reshape(-1, len(asked)), first + at):
                        # trees between two sizes of the grid are summed: no more is asked of them
                        start = max([n for n in bounds if n <= t], default=0)
                        sums.setdefault(start, np.zeros((len(depths), len(asked))))[k] += p
            for start, s in sums.items():
                yield pd.DataFrame({"hoja": leaf, "fold": fold, "row": asked, "filas": rows[asked], "desde": start,
                                    **{f"s_{k}": s[k] for k in range(len(depths))}})

    schema = "hoja int, fold int, row bigint, filas bigint, desde int, " + ", ".join(f"s_{k} double" for k in range(len(depths)))
    return spark.range(0, len(todo), 1, len(todo)).mapInPandas(votes, schema)


def recalls_of_cells(spark: SparkSession, cells: FO.Cells, parts: list) -> dict:
    """{(minimum leaf size, fold): {(trees, depth): recall of class 1}} of the forests whose ``parts`` are grown."""
    held = spark.sparkContext.broadcast(tuple(cells))
    try:
        sums = cell_votes(spark, held, parts).groupBy("hoja", "fold", "row", "filas").agg(*[
            F.sum(F.when(F.col("desde") < n, F.col(f"s_{k}"))).alias(_cell(n, k)) for n, k in _cells()])
        found = sums.groupBy("hoja", "fold").agg(F.sum("filas").alias("p"), *[
            F.sum(F.when(F.col(_cell(n, k)) > n / 2, F.col("filas")).otherwise(0)).alias(f"t_{n}_{k}") for n, k in _cells()]).collect()
    finally:
        held.destroy()
    return {(r["hoja"], r["fold"]): {(n, GRID_DEPTH[k]): r[f"t_{n}_{k}"] / r["p"] for n, k in _cells()} for r in found}


def recalls_of_parts(train: DataFrame, features, parts: list, parallelism: int) -> dict:
    """As :func:`recalls_of_cells`, the parts grown by Spark ML: for more cells than a task holds.  A part's votes are
    written and its trees dropped, so the driver never holds a whole forest."""
    spark = train.sparkSession
    base = f"{ensure_checkpoint_dir(spark, local_fallback=True)}/grid-{uuid.uuid4().hex}"
    assembled = assemble(features).transform(train)
    # rows are numbered once, for the parts of a forest to meet
    train.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{base}/rows")
    numbered = assemble(features).transform(spark.read.parquet(f"{base}/rows"))

    def part(item):
        leaf, fold, first, est = item
        model = est.setLeafCol("leaf").fit(assembled.filter(F.col("fold") != fold))
        votes = grid_votes(model, numbered.filter(F.col("fold") == fold), f"{base}/{leaf}-{fold}-{first}", first)
        votes.write.parquet(f"{base}/votes/{leaf}-{fold}/{first}")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        list(pool.map(part, parts))
    folders: dict = {}
    for leaf, fold, first, _ in parts:
        folders.setdefault((leaf, fold), []).append(f"{base}/votes/{leaf}-{fold}/{first}")
    return {at: recalls_of_votes(spark.read.parquet(*paths)) for at, paths in folders.items()}


def grid_search(train: DataFrame, features, weight: str = "peso", parallelism: int = 4):
    """The reference's forest grid by recall of class 1 over the ``fold`` column; refits the best.

    One forest with the most trees and no depth limit is grown per minimum
    leaf size and fold; its first trees, cut at each depth, stand for the other
    points of the grid, so 15 forests give all 36 × 5 recalls.  A forest is
    grown in parts of ``GRID_TREES_AT_ONCE`` trees, each with its own seed, on
    the distinct binned rows of all of ``train``.
    """
    spark = train.sparkSession
    assembled = assemble(features).transform(train)

    def forest(trees, depth, leaf, seed=SEED):
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol=weight, seed=seed, numTrees=trees,
                                      maxDepth=SPARK_MAX_DEPTH if depth is None else depth, minInstancesPerNode=leaf,
                                      cacheNodeIds=True, maxMemoryInMB=1024)

    trees = max(GRID_TREES)
    parts = [(leaf, fold, first, forest(min(GRID_TREES_AT_ONCE, trees - first), None, leaf, SEED + first))
             for leaf in GRID_MIN_LEAF for fold in range(N_FOLDS) for first in range(0, trees, GRID_TREES_AT_ONCE)]
    cells = binned_cells(train, features, weight, parts[0][-1].getMaxBins()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held = held_cells(cells, features, weight)
    finally:
        cells.unpersist()
    found = recalls_of_parts(train, features, parts, parallelism) if held is None else recalls_of_cells(spark, held, parts)
    rows = []
    for trees in GRID_TREES:
        for depth in GRID_DEPTH:
            for leaf in GRID_MIN_LEAF:
                # a fold without rows of class 1 finds none
                recalls = [found.get((leaf, fold), {}).get((trees, depth), 0.0) for fold in range(N_FOLDS)]
                rows.append((trees, SPARK_MAX_DEPTH if depth is None else depth, leaf, sum(recalls) / len(recalls)))
    table = spark.createDataFrame(rows, "num_trees int, max_depth int, min_leaf int, recall_cv double")
    best_row = max(enumerate(rows), key=lambda x: (x[1][3], -x[0]))[1]
    best = PipelineModel(stages=[assemble(features), forest(*best_row[:3]).fit(assembled)])
    return best, table, best_row


def tune_forest(data: dict, features, key: str) -> tuple:
    """Grid search on the train rows of a :func:`prepare` result."""
    return grid_search(with_folds(data["train"], key), features)


def train_and_select(df: DataFrame, features, target: str, key: str, with_grid: bool = False) -> dict:
    """Fit the candidates (and optionally the tuned forest), evaluate on the
    test split and select by recall then F1 (first listed on ties)."""
    data = prepare(df, features, target, key)
    results = train_models(df, features, target, key, data=data)
    out = {"grid": None}
    if with_grid:
        t0 = time.perf_counter()
        best, out["grid"], out["grid_best"] = tune_forest(data, features, key)
        results["Random Forest (optimizado)"] = {
            "model": best, "metrics": evaluated(best, data["test"]),
            "seconds": round(time.perf_counter() - t0, 4), "scaled": False, "params": data["params"], "fills": data["fills"]}
    names = list(results)
    best_name = max(names, key=lambda n: (results[n]["metrics"]["recall"], results[n]["metrics"]["f1"],
                                          -names.index(n)))
    b = results[best_name]
    scored = b["model"].transform(data["test"]).select(F.col("label").cast("int").alias("label"),
                                                       F.col("prediction").cast("int").alias("pred"))
    conf = M.confusion(scored).first()
    out.update(results=results, best_name=best_name, best_model=b["model"], params=b["params"], fills=b["fills"],
               scaled=b["scaled"], feature_cols=[f"{c}_esc" for c in features] if b["scaled"] else list(features),
               confusion=df.sparkSession.createDataFrame([tuple(conf)], "tn bigint, fp bigint, fn bigint, tp bigint"))
    data["train"].unpersist()
    data["test"].unpersist()
    return out


SELECTION_RULE = "Máximo Recall (coste de falso negativo alto), desempate por F1"  # FIXED VALUE


def metrics_document(trained: dict, quality: DataFrame, seconds: float) -> DataFrame:
    """The run's metrics document as one nested row (models map, 2×2
    confusion, importances, tuned parameters, data-quality summary).

    Everything in it is bounded by the number of models / features / classes;
    ``quality`` is the one-row ``quality_report``.
    """
    spark = quality.sparkSession
    res = trained["results"]
    per_model = F.create_map(*[x for name, r in res.items() for x in (
        F.lit(name), F.struct(*[F.lit(float(r["metrics"][k])).alias(k) for k in
                                ("accuracy", "precision", "recall", "f1", "roc_auc", "gini")],
                              F.lit(r["seconds"]).cast("double").alias("tiempo_entrenamiento_s"),
                              F.lit(bool(r["scaled"])).alias("escalado")))])
    conf = trained["confusion"].first()
    imp = importances(trained["best_model"], trained["feature_cols"]).collect()
    imp_map = F.create_map(*[x for r in imp for x in (F.lit(r.variable), F.lit(round(r.importancia, 4)))])
    best_row = trained.get("grid_best")
    hyper = (F.create_map(F.lit("n_estimators"), F.lit(best_row[0]), F.lit("max_depth"), F.lit(best_row[1]),
                          F.lit("min_samples_leaf"), F.lit(best_row[2]))
             if best_row else F.create_map().cast("map<string,int>"))
    return quality.select(
        F.lit(trained["best_name"]).alias("modelo_seleccionado"),
        F.lit(SELECTION_RULE).alias("criterio_seleccion"),
        hyper.alias("hiperparametros_optimizados"),
        F.lit(round(best_row[3], 4) if best_row else None).cast("double").alias("recall_cv5_optimizado"),
        F.array(F.array(F.lit(conf["tn"]), F.lit(conf["fp"])),
                F.array(F.lit(conf["fn"]), F.lit(conf["tp"]))).alias("matriz_confusion"),
        F.struct("n_filas", "n_columnas", F.col("total_nulos").alias("nulos"), "duplicados",
                 F.col("balance_pct"), "ratio_desbalance").alias("calidad_datos"),
        per_model.alias("metricas_por_modelo"),
        imp_map.alias("importancia_variables"),
        F.lit(round(seconds, 3)).alias("tiempo_total_s"))
