"""Classification metrics and the aggregates behind the reference's charts.

Everything is an aggregate over a (label, score/prediction) frame:

* confusion / precision / recall / F1: one fused ``count_if`` aggregate;
* exact tie-aware ROC-AUC: scores are first grouped (one row per distinct
  score, hot scores collapse map-side), then a running count of negatives
  below each score is computed with *two-pass offsets*: the distinct scores
  are cut into value-range buckets (bounds from a bounded sample), per-bucket
  totals (one row per bucket) give each bucket's offset, and a running sum
  inside each bucket finishes the job.  No unpartitioned window over raw rows;
* correlation / histogram / boxplot: fused aggregates and exact quantiles
  from ``cauce.operators.quality``.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce.operators import quality as Q
from cauce.operators.ordering import cumulative_below


MAX_CLASSES = 100  # classes whose box statistics are planned and broadcast at most


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """TN, FP, FN, TP in one row."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _rates(decimals: int) -> list:
    """accuracy, precision, recall, f1 from columns tp, fp, fn, tn (0 on zero division)."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return [F.round(_safe_div(tp + tn, tp + tn + fp + fn), decimals).alias("accuracy"),
            F.round(_safe_div(tp, tp + fp), decimals).alias("precision"),
            F.round(_safe_div(tp, tp + fn), decimals).alias("recall"),
            F.round(_safe_div(2 * tp, 2 * tp + fp + fn), decimals).alias("f1")]


def class_metrics(df: DataFrame, label: str = "label", pred: str = "pred", decimals: int = 4) -> DataFrame:
    """accuracy, precision, recall, F1 (0 on zero division), rounded."""
    return confusion(df, label, pred).select(*_rates(decimals))


def score_groups(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg, filas) per distinct score; ``filas`` counts rows without a label too."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"),
        F.count(F.lit(1)).alias("filas"))


def running_below(groups: DataFrame, order: str, cols) -> DataFrame:
    """For each row, the sums of ``cols`` over all rows with a smaller ``order``
    (unique in ``groups``): value-range buckets from a bounded sample give
    per-bucket offsets, then running sums inside each bucket."""
    return cumulative_below(groups, order, cols)


def auc_gini(df: DataFrame, label: str = "label", score: str = "score", decimals: int = 4) -> DataFrame:
    """Exact ROC-AUC with ties counted as 1/2 (Mann-Whitney), Gini = 2·AUC − 1; null when a class is missing.

    AUC = (2·Σ pos·neg_below + Σ pos·neg) / (2·P·N), summed as exact decimals.
    """
    return auc_of_groups(score_groups(df, label, score), decimals)


def auc_of_groups(groups: DataFrame, decimals: int = 4) -> DataFrame:
    """:func:`auc_gini` from one row per distinct score (score, pos, neg)."""
    g = running_below(groups, "score", ["neg"])
    dec = "decimal(38,0)"
    s = g.agg((2 * F.sum((F.col("pos") * F.col("neg_below")).cast(dec))
               + F.sum((F.col("pos") * F.col("neg")).cast(dec))).alias("num"),
              F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = F.try_divide(F.col("num").cast("double"), 2 * F.col("P").cast("double") * F.col("N").cast("double"))
    return s.select(F.round(auc, decimals).alias("roc_auc"), F.round(2 * auc - 1, decimals).alias("gini"))


def threshold_table(df: DataFrame, thresholds: dict, label: str = "label", score: str = "score",
                    decimals: int = 4) -> DataFrame:
    """One row per named threshold classifier (score >= t): modelo, orden, the four class
    metrics and the common AUC and Gini — all from one pass that groups the scores."""
    return threshold_table_of_groups(score_groups(df, label, score), thresholds, decimals)


def threshold_table_of_groups(groups: DataFrame, thresholds: dict, decimals: int = 4) -> DataFrame:
    """:func:`threshold_table` from one row per distinct score (:func:`score_groups`)."""
    auc = auc_of_groups(groups, decimals).select(F.struct("roc_auc", "gini")).scalar()
    zero = F.lit(0)
    parts = []
    for i, (name, t) in enumerate(thresholds.items()):
        hit = F.col("score") >= t
        parts.append(F.struct(
            F.lit(name).alias("modelo"), F.lit(i).alias("orden"),
            F.sum(F.when(hit, F.col("pos")).otherwise(zero)).alias("tp"),
            F.sum(F.when(hit, F.col("neg")).otherwise(zero)).alias("fp"),
            F.sum(F.when(hit, zero).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(hit, zero).otherwise(F.col("neg"))).alias("tn")))
    counted = groups.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("s")).select("s.*")
    return counted.select("modelo", "orden", *_rates(decimals), auc["roc_auc"].alias("roc_auc"), auc["gini"].alias("gini"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(umbral, fpr, tpr, tp, fp) for every distinct score used as threshold (score >= t),
    after the curve's origin (no threshold, 0, 0); rates are null when a class is missing."""
    groups = score_groups(df, label, score)
    g = running_below(groups, "score", ["pos", "neg"])
    total = groups.agg(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar()
    tp = total["P"] - F.col("pos_below")
    fp = total["N"] - F.col("neg_below")
    points = g.select(F.col("score").alias("umbral"), F.try_divide(fp, total["N"]).alias("fpr"),
                      F.try_divide(tp, total["P"]).alias("tpr"), tp.alias("tp"), fp.alias("fp"))
    kinds = dict(points.dtypes)
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast(kinds["umbral"]).alias("umbral"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(0).cast(kinds["tp"]).alias("tp"), F.lit(0).cast(kinds["fp"]).alias("fp"))
    return origin.unionByName(points)


def class_report(df: DataFrame, label: str = "label", pred: str = "pred", decimals: int = 4) -> DataFrame:
    """Per class precision/recall/F1/support plus macro and weighted averages."""
    c = confusion(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    # class 1 is positive as is; class 0 swaps the roles
    per = {
        "0": (tn, fn, fp, tn + fp),
        "1": (tp, fp, fn, tp + fn),
    }
    rows = []
    for k, (t, f_p, f_n, sup) in per.items():
        p = _safe_div(t, t + f_p)
        r = _safe_div(t, t + f_n)
        f = _safe_div(2 * t, 2 * t + f_p + f_n)
        rows.append(F.struct(F.lit(k).alias("clase"), p.alias("precision"), r.alias("recall"),
                             f.alias("f1"), sup.cast("double").alias("support")))
    per_class = c.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    tot = F.sum("support")
    avg = per_class.agg(
        F.struct(F.lit("macro avg").alias("clase"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("clase"),
                 (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                 (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support")).alias("w"))
    avgs = avg.select(F.explode(F.array("m", "w")).alias("s")).select("s.*")
    out = per_class.unionByName(avgs)
    return out.select("clase", *[F.round(c_, decimals).alias(c_) for c_ in ("precision", "recall", "f1")],
                      "support")


def correlation(df: DataFrame, cols, decimals: int = 4) -> DataFrame:
    """Pearson matrix in long form (col_a, col_b, corr) from one aggregate; a pair skips rows that lack a value."""
    df = Q.nan_as_null(df, cols)
    pairs = [(a, b) for a in cols for b in cols]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
            for a, b in pairs if a < b]
    row = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    structs = []
    for a, b in pairs:
        if a == b:
            v = F.lit(1.0)
        else:
            lo, hi = sorted((a, b))
            v = F.col(f"{lo}__{hi}")
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                F.round(v, decimals).alias("corr")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def histogram(df: DataFrame, cols, bins: int = 20) -> DataFrame:
    """(columna, bin, n): equal-width bins over [min, max], last bin closed.

    One aggregate gives every column's min and max; one pass then unpivots
    (columna, bin) pairs and counts them with a single grouped aggregate.  Null and NaN are in no bin.
    """
    df = Q.nan_as_null(df, cols)
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in cols],
                *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in cols]).first()
    structs = []
    for c in cols:
        x = F.col(c).cast("double")
        lo, hi = mm[f"{c}__lo"], mm[f"{c}__hi"]
        if lo is None:
            continue
        b = F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins),
                                               F.lit(bins - 1)).cast("int")
        structs.append(F.struct(F.lit(c).alias("columna"), F.when(x.isNotNull(), b).alias("bin")))
    long = df.select(F.explode(F.array(*structs)).alias("s")).select("s.columna", "s.bin")
    return long.filter(F.col("bin").isNotNull()).groupBy("columna", "bin").agg(F.count(F.lit(1)).alias("n"))


def column_means(df: DataFrame, cols, decimals: int = 4) -> DataFrame:
    df = Q.nan_as_null(df, cols)
    m = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    return m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.round(F.col(c), decimals)
                                                  .alias("media")) for c in cols])).alias("s")).select("s.*")


def boxplot(df: DataFrame, cols, target: str) -> DataFrame:
    """Per feature × class: quartiles, 1.5·IQR whiskers and outlier count.

    Quartiles are exact (batched distributed selection over all
    feature × class series in the same passes); whiskers and outliers are
    one more grouped aggregate.
    """
    df = Q.nan_as_null(df, [*cols, target])
    known = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("clase"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")
    ).select("clase", "s.columna", "s.v").filter(F.col("v").isNotNull())
    classes = [r[0] for r in known.select("clase").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    qs = Q.quantiles_long(known.select(F.concat_ws("|", "columna", "clase").alias("sid"), "v"), [0.25, 0.5, 0.75])
    rows = []
    for c in cols:
        for k in classes:
            sid = f"{c}|{k}"
            if (sid, 0.25) in qs:
                q1, med, q3 = qs[(sid, 0.25)], qs[(sid, 0.5)], qs[(sid, 0.75)]
                iqr = q3 - q1
                rows.append((c, k, q1, med, q3, q1 - 1.5 * iqr, q3 + 1.5 * iqr))
    spark = df.sparkSession
    box = spark.createDataFrame(rows, "columna string, clase string, q1 double, mediana double, q3 double, "
                                      "lim_inf double, lim_sup double")
    j = known.join(F.broadcast(box), ["columna", "clase"])  # box: features × classes rows (bounded)
    inside = (F.col("v") >= F.col("lim_inf")) & (F.col("v") <= F.col("lim_sup"))
    return j.groupBy("columna", "clase", "q1", "mediana", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("bigote_inf"),
        F.max(F.when(inside, F.col("v"))).alias("bigote_sup"),
        F.count_if(~inside).alias("atipicos"))
