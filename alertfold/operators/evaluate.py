"""Reduction rates, gap sensitivity, score quality and scorecards."""

from pyspark.sql import DataFrame, Window, functions as F

from alertfold import schema as S
from alertfold.functions import scalar as X
from alertfold.operators import sessions as A
from alertfold.operators.chains import BLOCK_CAPS, chain_counts
from alertfold.schema import MINUTE_US


def reduction(n_in: DataFrame, metas: DataFrame) -> DataFrame:
    """One row: input rows, meta-alerts and the reduction rate; late rows count as input."""
    raw = n_in.agg(F.count("*").alias("n_raw"))
    folded = metas.agg(F.count("*").alias("n_meta"))
    return raw.crossJoin(F.broadcast(folded)).select(
        "n_raw", "n_meta", F.round(X.reduction_rate(F.col("n_meta"), F.col("n_raw")), 4).alias("arr_pct"))


# ---- sensitivity to the gap ------------------------------------------------------------------------

def sensitivity_sweep(
    alerts: DataFrame, minutes: list[int] = S.SWEEP_MINUTES, cap_minutes: int | None = 60, k: int = 50,
    lateness_sec: float = 60.0, block_caps: int = BLOCK_CAPS, n_blocks: int | None = None,
) -> DataFrame:
    """Meta-alerts and reduction rate per gap, in one pass over the alerts.

    What a gap makes of a key depends only on the distinct newest-so-far times of its alerts, whatever the gap; these are
    counted under all gaps at once (``chains.chain_counts``).
    """
    kept = A.with_key(A.ordered_alerts(alerts.select("event_id", "arrival_us", "timestamp", *A.KEYS), k, lateness_sec, n_blocks))
    cap = None if cap_minutes is None else cap_minutes * MINUTE_US
    counts = chain_counts(A.newest_times(kept), A.KEYS, [m * MINUTE_US for m in minutes], cap, block_caps)
    n_meta = counts.select((F.col("gap_us") / MINUTE_US).cast("int").alias("delta_t_min"), F.col("n").alias("n_meta"))
    raw = alerts.agg(F.count("*").alias("n_raw"))
    return n_meta.crossJoin(F.broadcast(raw)).select(
        "delta_t_min", "n_raw", "n_meta",
        F.round(X.reduction_rate(F.col("n_meta"), F.col("n_raw")), 2).alias("arr_pct"))


def elbow(sweep: DataFrame) -> DataFrame:
    """The gap at the elbow of the sweep: the largest second difference if it exceeds 0.5, else the point farthest
    from the diagonal. Runs on the sweep table, one row per gap."""
    by_gap = Window.orderBy("delta_t_min")
    y, x = F.col("arr_pct"), F.col("delta_t_min")
    every = Window.partitionBy()
    unit = lambda c: (c - F.min(c).over(every)) / (F.max(c).over(every) - F.min(c).over(every) + 1e-9)
    second = F.lead(y).over(by_gap) - 2 * y + F.lag(y).over(by_gap)
    rows = sweep.select(
        x.alias("delta_t_min"), y.alias("arr_pct"), second.alias("bend"),
        (F.abs(unit(y) - unit(x)) / F.sqrt(F.lit(2.0))).alias("distance"),
        F.count("*").over(every).alias("n"))
    # The earliest point wins a tie, as does a table that is too short to bend.
    pick = rows.agg(
        F.max("n").alias("n"), F.min("delta_t_min").alias("first"), F.max("bend").alias("max_bend"),
        F.max_by("delta_t_min", F.struct("bend", -x)).alias("at_bend"),
        F.max_by("delta_t_min", F.struct("distance", -x)).alias("at_distance"))
    return pick.select(
        F.when(F.col("n") < 3, F.col("first")).when(F.col("max_bend") > 0.5, F.col("at_bend"))
        .otherwise(F.col("at_distance")).alias("delta_t_min"))


# ---- per rule group --------------------------------------------------------------------------------

def _per_group(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col("rule_groups").alias("rule_group")).agg(F.count("*").alias(name))


def reduction_per_group(alerts: DataFrame, metas: DataFrame, fixed: DataFrame) -> DataFrame:
    counts = (
        _per_group(alerts, "n_raw").join(_per_group(metas, "n_meta_session"), "rule_group", "left")
        .join(_per_group(fixed, "n_meta_fixed"), "rule_group", "left").na.fill(0)
    )
    session = X.reduction_rate(F.col("n_meta_session"), F.col("n_raw"))
    window = X.reduction_rate(F.col("n_meta_fixed"), F.col("n_raw"))
    return counts.select(
        "rule_group", "n_raw", "n_meta_session", F.round(session, 2).alias("arr_session_pct"), "n_meta_fixed",
        F.round(window, 2).alias("arr_fixed_pct"), F.round(session - window, 2).alias("delta_arr"))


def loss_analysis(alerts: DataFrame, metas: DataFrame, fixed: DataFrame) -> DataFrame:
    """Per rule group: reduction, mean bucket size and how many fixed windows hold less than half the median."""
    sizes = fixed.groupBy(F.col("rule_groups").alias("rule_group"), "alert_count").agg(F.count("*").alias("n"))
    middle = sizes.groupBy("rule_group").agg(F.percentile("alert_count", 0.5, F.col("n")).alias("median"))
    small = F.when(F.col("alert_count") < F.col("median") / 2, F.col("n")).otherwise(0)
    windows = sizes.join(middle, "rule_group").groupBy("rule_group").agg(
        F.sum("n").alias("fixed_n_meta"), F.sum(F.col("alert_count") * F.col("n")).alias("fixed_alerts"),
        F.sum(small).alias("fixed_fragmented"))
    folded = metas.groupBy(F.col("rule_groups").alias("rule_group")).agg(
        F.count("*").alias("session_n_meta"), F.sum("alert_count").alias("session_alerts"))
    all_ = _per_group(alerts, "raw_alerts").join(windows, "rule_group", "left").join(
        folded, "rule_group", "left").na.fill(0)
    fixed_arr = X.reduction_rate(F.col("fixed_n_meta"), F.col("raw_alerts"))
    session_arr = X.reduction_rate(F.col("session_n_meta"), F.col("raw_alerts"))
    return all_.select(
        "rule_group", "raw_alerts", "fixed_n_meta", "session_n_meta",
        F.round(fixed_arr, 1).alias("arr_fixed_pct"), F.round(session_arr, 1).alias("arr_session_pct"),
        F.round(session_arr - fixed_arr, 1).alias("delta_arr"),
        F.round(X.ratio_or_zero(F.col("fixed_alerts"), F.col("fixed_n_meta")), 1).alias("avg_alerts_fixed"),
        F.round(X.ratio_or_zero(F.col("session_alerts"), F.col("session_n_meta")), 1).alias("avg_alerts_session"),
        "fixed_fragmented")


# ---- score quality ---------------------------------------------------------------------------------

def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per stored score: at most 10,001 rows for scores with four decimals."""
    return scored.groupBy("anomaly_score").agg(
        F.sum(F.when(F.col("ground_truth") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("ground_truth") == 1, 0).otherwise(1)).alias("neg"))


def fpr_sweep(scored: DataFrame, steps: int = 40) -> DataFrame:
    """Confusion counts and rates at ``steps + 1`` thresholds. Empty when there are no positives."""
    thresholds = scored.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("t"))
    flagged = F.col("anomaly_score") >= F.col("t")
    total = lambda flag, c: F.sum(F.when(flag, F.col(c)).otherwise(0))
    sums = score_counts(scored).crossJoin(F.broadcast(thresholds)).groupBy("t").agg(
        total(flagged, "pos").alias("tp"), total(~flagged, "pos").alias("fn"),
        total(flagged, "neg").alias("fp"), total(~flagged, "neg").alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return sums.where(tp + fn > 0).select(
        F.round("t", 3).alias("threshold"),
        F.round((fn + tn) / (tp + fn + fp + tn) * 100, 2).alias("reduction_pct"),
        F.round(X.ratio_or_zero(fp, fp + tn), 4).alias("fpr"),
        F.round(X.ratio_or_zero(tp, tp + fp), 4).alias("precision"),
        F.round(X.ratio_or_zero(tp, tp + fn), 4).alias("recall"), "tp", "fn", "fp", "tn")


def _pr_points(scored: DataFrame) -> DataFrame:
    falling = Window.orderBy(F.desc("anomaly_score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return score_counts(scored).select(
        "anomaly_score", "pos", F.sum("pos").over(falling).alias("tp"), F.sum("neg").over(falling).alias("fp"),
        F.sum("pos").over(every).alias("n_pos")).where(F.col("n_pos") > 0)


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score."""
    return _pr_points(scored).select(
        F.col("anomaly_score").alias("threshold"),
        F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.col("tp") / F.col("n_pos"), 6).alias("recall"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision: recall steps weighted by precision. Null without positives."""
    step = F.col("pos") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return _pr_points(scored).agg(F.round(F.sum(step), 4).alias("pr_auc"))


def _confusion(scored: DataFrame) -> DataFrame:
    y, p = F.col("ground_truth") == 1, F.col("escalate") == 1
    n = lambda c: F.count(F.when(c, 1))
    return scored.agg(n(y & p).alias("tp"), n(y & ~p).alias("fn"), n(~y & p).alias("fp"), n(~y & ~p).alias("tn"))


def _fbeta(beta: float):
    b = beta * beta
    top = (1 + b) * F.col("tp")
    bottom = (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp")
    return F.when(F.col("tp") + F.col("fn") > 0, F.round(X.ratio_or_zero(top, bottom), 4))


def fbeta(scored: DataFrame) -> DataFrame:
    return _confusion(scored).select(_fbeta(0.5).alias("f05"), _fbeta(1.0).alias("f1"))


def false_negative_rate(scored: DataFrame) -> DataFrame:
    return _confusion(scored).select(
        "fn", "tp", F.when(F.col("tp") + F.col("fn") > 0, F.round(F.col("fn") / (F.col("tp") + F.col("fn")), 4)).alias("fnr"))


def triage_load(scored: DataFrame) -> DataFrame:
    n = F.col("alert_count")
    sums = scored.agg(
        F.count("*").alias("n_meta"), F.sum(n).alias("n_raw"), F.avg(n).alias("avg_all"),
        F.avg(F.when(F.col("escalate") == 1, n)).alias("avg_esc"))
    return sums.select(
        F.round("avg_all", 2).alias("avg_alerts_per_meta_all"), F.round("avg_esc", 2).alias("avg_alerts_per_meta_escalate"),
        F.round(F.when(F.col("n_meta") > 0, F.col("n_raw") / F.col("n_meta")).otherwise(1.0), 2).alias("compression_ratio"),
        F.round(X.reduction_rate(F.col("n_meta"), F.col("n_raw")), 2).alias("triage_load_reduction_pct"))


def session_scorecard(metas: DataFrame, per_group: DataFrame, target: float = 80.0) -> DataFrame:
    """One row: reduction over the folded alerts, compression, low-severity share and the spread over rule groups."""
    sums = metas.agg(
        F.sum("alert_count").alias("n_raw"), F.count("*").alias("n_meta"),
        F.count(F.when(F.col("max_severity") < S.HIGH_SEVERITY, 1)).alias("n_low"))
    arr = F.col("arr_session_pct")
    below = arr < target
    expected = F.col("rule_group").isin(S.EXPECTED_LOW_REDUCTION)
    groups = per_group.agg(
        F.min(arr).alias("arr_min"), F.max(arr).alias("arr_max"), F.round(F.avg(arr), 4).alias("arr_mean"),
        F.count(F.when(below & expected, 1)).alias("n_below_expected"),
        F.count(F.when(below & ~expected, 1)).alias("n_below_unexpected"))
    return sums.crossJoin(F.broadcast(groups)).select(
        "n_raw", "n_meta", F.round(X.reduction_rate(F.col("n_meta"), F.col("n_raw")), 2).alias("arr_pct"),
        F.round(F.col("n_raw") / F.greatest("n_meta", F.lit(1)), 2).alias("compression_ratio"),
        F.round(F.col("n_low") / F.col("n_meta") * 100, 2).alias("low_severity_pct"),
        "arr_min", "arr_max", "arr_mean", "n_below_expected", "n_below_unexpected")


def groups_below_target(per_group: DataFrame, target: float = 80.0) -> DataFrame:
    return per_group.where(F.col("arr_session_pct") < target).select(
        "rule_group", "arr_session_pct", F.when(
            F.col("rule_group").isin(S.EXPECTED_LOW_REDUCTION), 1).otherwise(0).alias("expected_low"))


def model_scorecard(scored: DataFrame) -> DataFrame:
    """One row: size, positives and the score metrics."""
    one = _confusion(scored).select(
        (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n_total"),
        (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"),
        _fbeta(0.5).alias("f05"), _fbeta(1.0).alias("f1"),
        F.when(F.col("tp") + F.col("fn") > 0, F.round(F.col("fn") / (F.col("tp") + F.col("fn")), 4)).alias("fnr"))
    return one.crossJoin(F.broadcast(pr_auc(scored))).select(
        "n_total", "n_pos", "n_neg", F.round(F.col("n_pos") / F.col("n_total") * 100, 2).alias("positive_pct"),
        "pr_auc", "f05", "f1", "fnr")


def severity_distribution(metas: DataFrame) -> DataFrame:
    return metas.groupBy("max_severity").agg(F.count("*").alias("n"))


def compression_histogram(metas: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of bucket sizes; the largest value belongs to the last bin."""
    sizes = metas.groupBy("alert_count").agg(F.count("*").alias("n"))
    span = sizes.agg(F.min("alert_count").alias("lo"), F.max("alert_count").alias("hi"))
    slot = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("alert_count") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return sizes.crossJoin(F.broadcast(span)).groupBy(slot.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
