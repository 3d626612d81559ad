"""Classification/regression evaluation (A8-A12, W1-W6; metric names per §2.10).

Positive class = pass (1).  false fail = predicted 0 but truly 1 (FN);
false pass = predicted 1 but truly 0 (FP).  All four confusion cells are
always present; a ratio with a zero denominator is NULL.

Scale notes: confusion counts are ``count_if`` aggregates (one pass, map-side
partial).  ROC/AUC first collapse rows to unique scores, then sum over ranges
of them (``ranking.running_sums``), so no task ever sorts all scores.  The
0..1 sweep buckets scores into its 101 cuts and suffix-sums 102 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import safe_ratio
from cohortlens.session import materialize
from cohortlens.operators.ranking import running_sums

CELLS = ("tn", "fn", "fp", "tp")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify(score, threshold: float, strict: bool = False) -> Column:
    """0/1 prediction: ``score > t`` (strict, G2/G3) or ``score >= t``."""
    s = _c(score)
    cond = s > F.lit(float(threshold)) if strict else s >= F.lit(float(threshold))
    return F.when(s.isNotNull(), cond.cast("int"))


def confusion_exprs(label, pred) -> list[Column]:
    y, p = _c(label), _c(pred)
    return [F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 0) & (y == 1)).alias("fn"),
            F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 1) & (y == 1)).alias("tp")]


def confusion(df: DataFrame, label: str = "final", pred: str = "pred",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """``table(pred, true)`` as one row (per group) ``tn, fn, fp, tp``."""
    if group_cols:
        return df.groupBy(*group_cols).agg(*confusion_exprs(label, pred))
    return df.agg(*confusion_exprs(label, pred))


def metric_columns(tn="tn", fn="fn", fp="fp", tp="tp") -> dict[str, Column]:
    """The §2.10 metrics from the four cells."""
    tn, fn, fp, tp = _c(tn), _c(fn), _c(fp), _c(tp)
    n = tn + fn + fp + tp
    acc = safe_ratio(tn + tp, n)
    return {
        "accuracy": acc,
        "misclassification": F.lit(1.0) - acc,
        "specificity": safe_ratio(tn, tn + fp),
        "sensitivity": safe_ratio(tp, tp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "npv": safe_ratio(tn, tn + fn),
    }


def with_metrics(conf: DataFrame) -> DataFrame:
    return conf.withColumns(metric_columns())


def classification_report(df: DataFrame, label: str = "final", pred: str = "pred",
                          group_cols: Sequence[str] = ()) -> DataFrame:
    """A8 + A9 in one aggregate pass."""
    return with_metrics(confusion(df, label, pred, group_cols))


def regression_as_classifier(df: DataFrame, y: str = "final", pred: str = "pred", mark: float = 50.0,
                             group_cols: Sequence[str] = ()) -> DataFrame:
    """A10 (+A11): mark the truth *and* the prediction at ``mark``.

    Cells in the reference's flattened order: true_fail, false_pass,
    false_fail, true_pass; plus accuracy, specificity (its "sensitivity"),
    npv (its "precision") and mse.
    """
    yv, pv, m = F.col(y), F.col(pred), F.lit(float(mark))
    aggs = [F.count_if((yv < m) & (pv < m)).alias("true_fail"),
            F.count_if((yv < m) & (pv >= m)).alias("false_pass"),
            F.count_if((yv >= m) & (pv < m)).alias("false_fail"),
            F.count_if((yv >= m) & (pv >= m)).alias("true_pass"),
            F.avg(F.pow(yv - pv, 2)).alias("mse")]
    out = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    tf, fp, ff, tp = (F.col(c) for c in ("true_fail", "false_pass", "false_fail", "true_pass"))
    return out.withColumns({
        "accuracy": safe_ratio(tf + tp, tf + tp + fp + ff),
        "specificity": safe_ratio(tf, tf + fp),
        "npv": safe_ratio(tf, tf + ff),
        "sensitivity": safe_ratio(tp, tp + ff),
    })


def mse(df: DataFrame, y: str, pred: str) -> DataFrame:
    """A11."""
    return df.agg(F.avg(F.pow(F.col(y) - F.col(pred), 2)).alias("mse"))


def misclassification_cost(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``mean(abs(y - p) > 0.5)``."""
    e = F.avg((F.abs(F.col(y) - F.col(p)) > F.lit(0.5)).cast("double")).alias("cost")
    return df.groupBy(*group_cols).agg(e) if group_cols else df.agg(e)


# ---------------------------------------------------------------- ROC / AUC

def score_counts(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Collapse rows to unique scores: (group..., score, pos, neg)."""
    y = F.col(label)
    return (df.where(y.isNotNull() & F.col(score).isNotNull())
            .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def _grouped(df: DataFrame, group_cols: Sequence[str]):
    """Ungrouped calls run as one group keyed by a constant, so every join
    below is an equi-join (no keyless/cross join of even a one-row table)."""
    if group_cols:
        return df, list(group_cols), []
    return df.withColumn("_g", F.lit(0)), ["_g"], ["_g"]


def _cumulative_scores(df, label, score, g):
    # the unique scores are dealt to ranges, which samples them first: checkpoint
    # them once instead of replaying the scoring upstream
    return _cumulative_counts(materialize(score_counts(df, label, score, g)), g)


def _cumulative_counts(u, g):
    return materialize(running_sums(u, "score", ["pos", "neg"], g, with_next="next_score"))


def _directions(cum: DataFrame, g) -> DataFrame:
    """Exact class medians (R ``median``) read off the cumulative table, and
    pROC's automatic direction: controls (class 0) above cases -> '>'."""
    def med(cnt, tot):
        k1 = F.floor((F.col(tot) + 1) / 2)
        k2 = F.floor(F.col(tot) / 2) + 1
        lo = F.min(F.when(F.col(cnt) >= k1, F.col("score")))
        hi = F.min(F.when(F.col(cnt) >= k2, F.col("score")))
        return (lo + hi) / 2
    med_df = cum.groupBy(*g).agg(med("neg_cum", "neg_tot").alias("median_neg"),
                                 med("pos_cum", "pos_tot").alias("median_pos"),
                                 F.max("pos_tot").alias("n_pos"), F.max("neg_tot").alias("n_neg"))
    return med_df.withColumn("direction", F.when(F.col("median_neg") > F.col("median_pos"), F.lit(">"))
                             .otherwise(F.lit("<")))


def roc_curve(df: DataFrame, label: str = "final", score: str = "score",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """W1 (+W3): exact ROC over all cut points.

    Thresholds are -Inf, the midpoints of adjacent unique scores, and +Inf;
    direction is chosen from the class medians like pROC's ``"auto"``.
    Columns: group..., threshold, direction, sensitivity, specificity,
    youden, plus the integer ``youden_num`` = youden * n_pos * n_neg for
    exact tie handling.
    """
    df, g, extra = _grouped(df, group_cols)
    cum = _cumulative_scores(df, label, score, g)
    dirs = materialize(_directions(cum, g))  # one row per group
    lt = F.col("direction") == "<"
    inner = cum.join(dirs, g).select(
        *g, F.when(F.col("next_score").isNull(), F.lit(float("inf")))
             .otherwise((F.col("score") + F.col("next_score")) / 2).alias("threshold"),
        "direction", "n_pos", "n_neg",
        F.when(lt, F.col("n_pos") - F.col("pos_cum")).otherwise(F.col("pos_cum")).alias("tp"),
        F.when(lt, F.col("neg_cum")).otherwise(F.col("n_neg") - F.col("neg_cum")).alias("tn"))
    first = dirs.select(*g, F.lit(float("-inf")).alias("threshold"), "direction", "n_pos", "n_neg",
                        F.when(lt, F.col("n_pos")).otherwise(F.lit(0)).cast("long").alias("tp"),
                        F.when(lt, F.lit(0)).otherwise(F.col("n_neg")).cast("long").alias("tn"))
    out = inner.unionByName(first).select(
        *g, "threshold", "direction",
        safe_ratio("tp", "n_pos").alias("sensitivity"),
        safe_ratio("tn", "n_neg").alias("specificity"),
        (safe_ratio("tp", "n_pos") + safe_ratio("tn", "n_neg") - F.lit(1.0)).alias("youden"),
        (F.col("tp") * F.col("n_neg") + F.col("tn") * F.col("n_pos") - F.col("n_pos") * F.col("n_neg"))
        .alias("youden_num"))
    return out.drop(*extra)


def auc(df: DataFrame, label: str = "final", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact AUC (Mann-Whitney with mid-ranks for ties), pROC direction.

    ``sum_s pos_s * (neg below s + neg_s / 2) / (P * N)``; 1 - that when
    controls lie above cases.  Columns: group..., auc, direction, n_pos, n_neg.
    """
    df, g, extra = _grouped(df, group_cols)
    return _auc(_cumulative_scores(df, label, score, g), g).drop(*extra)


def auc_of_counts(counts: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """W2 from (group..., score, pos, neg) rows with unique scores, as ``score_counts`` gives."""
    return _auc(_cumulative_counts(counts, list(group_cols)), list(group_cols))


def confusion_of_counts(counts: DataFrame, group_cols: Sequence[str], threshold: float) -> DataFrame:
    """A8 of ``score > threshold`` from (group..., score, pos, neg) rows."""
    high = F.col("score") > F.lit(float(threshold))
    return counts.groupBy(*group_cols).agg(*[F.sum(F.when(cond, F.col(n)).otherwise(0)).alias(c) for c, cond, n in (
        ("tn", ~high, "neg"), ("fn", ~high, "pos"), ("fp", high, "neg"), ("tp", high, "pos"))])


def _auc(cum: DataFrame, g: Sequence[str]) -> DataFrame:
    dirs = _directions(cum, g)
    u = cum.groupBy(*g).agg(F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") * F.lit(0.5))).alias("u"))
    lt = safe_ratio(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))  # one class: NULL
    return u.join(dirs, g).select(
        *g, F.when(F.col("direction") == "<", lt).otherwise(F.lit(1.0) - lt).alias("auc"),
        "direction", "n_pos", "n_neg")


def best_threshold(roc: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """First maximum of Youden's J in threshold order (ascending for '<',
    descending for '>'), compared exactly on the integer numerator.

    An arg-max aggregate over a struct (J first, then threshold order), so it
    is partial-aggregated on the map side -- no window over the whole curve.
    """
    g = list(group_cols)
    order_t = F.when(F.col("direction") == "<", F.col("threshold")).otherwise(-F.col("threshold"))
    best = F.max(F.struct(F.col("youden_num").alias("j"), (-order_t).alias("o"), "threshold", "youden",
                          "sensitivity", "specificity")).alias("b")
    agg = roc.groupBy(*g).agg(best) if g else roc.agg(best)
    return agg.select(*g, "b.threshold", "b.youden", "b.sensitivity", "b.specificity")


def threshold_sweep(df: DataFrame, label: str = "final", score: str = "score",
                    group_cols: Sequence[str] = (), steps: int = 100) -> DataFrame:
    """Metrics at every cut t = j/steps, j = 0..steps (``score < t`` -> 0).

    Each score goes to the bucket k = largest j with j/steps <= score (-1 below
    0), counts are taken per (group, k), and a suffix sum over the <= steps+2
    buckets gives the predicted-positive counts of every cut at once.
    """
    g = list(group_cols)
    s = F.col(score).cast("double")
    k0 = F.least(F.greatest(F.floor(s * steps), F.lit(-1)), F.lit(steps)).cast("int")
    up = F.when((k0 < steps) & ((k0 + 1) / F.lit(float(steps)) <= s), k0 + 1).otherwise(k0)
    k = F.when((up >= 0) & (up / F.lit(float(steps)) > s), up - 1).otherwise(up)
    y = F.col(label)
    counts = (df.where(y.isNotNull() & s.isNotNull()).groupBy(*g, k.alias("k"))
              .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))
    groups = counts.select(*g).distinct() if g else None
    grid = (groups.select(*g, F.explode(F.sequence(F.lit(-1), F.lit(steps))).alias("k")) if g
            else counts.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("k")))
    dense = grid.join(counts, [*g, "k"], "left").fillna(0, subset=["pos", "neg"])
    wsuf = Window.partitionBy(*g).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(*g)
    sw = dense.select(*g, "k",
                      F.sum("pos").over(wsuf).alias("tp"), F.sum("neg").over(wsuf).alias("fp"),
                      F.sum("pos").over(wall).alias("n_pos"), F.sum("neg").over(wall).alias("n_neg"))
    sw = sw.where(F.col("k") >= 0).select(
        *g, (F.col("k") / F.lit(float(steps))).alias("threshold"),
        (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"), "fp", "tp")
    sw = sw.withColumns(metric_columns())
    return sw.withColumn("youden", F.col("sensitivity") + F.col("specificity") - F.lit(1.0)).drop(
        "misclassification")


def threshold_table(df: DataFrame, best: float, label: str = "final", score: str = "score",
                    base: float = 0.5) -> DataFrame:
    """Metrics at ``base``, halfway ``(best + base) / 2`` and ``best``.

    One aggregate pass (12 ``count_if``).  AUC of a hard 0/1 prediction is
    (sensitivity + specificity) / 2.  Rows keep the three thresholds paired
    with their own AUC (the reference swaps two of them).
    """
    ts = [("base", base), ("halfway", (best + base) / 2.0), ("best", best)]
    y, s = F.col(label), F.col(score)
    aggs = []
    for name, t in ts:
        p = s >= F.lit(float(t))
        aggs += [F.count_if(~p & (y == 0)).alias(f"{name}_tn"), F.count_if(~p & (y == 1)).alias(f"{name}_fn"),
                 F.count_if(p & (y == 0)).alias(f"{name}_fp"), F.count_if(p & (y == 1)).alias(f"{name}_tp")]
    wide = df.where(y.isNotNull() & s.isNotNull()).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(float(t)).alias("threshold"),
                              *[F.col(f"{name}_{c}").alias(c) for c in CELLS]) for name, t in ts])
    long = wide.select(F.inline(rows))
    long = long.withColumns(metric_columns())
    return long.select("rule", "threshold",
                       ((F.col("sensitivity") + F.col("specificity")) / 2).alias("auc"),
                       "accuracy", "specificity", "npv", "sensitivity", F.col("fn").alias("false_fails"),
                       F.col("fp").alias("false_passes"))
