"""Scaling, thresholds, the decision matrix and what is sent out for escalated meta-alerts."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertfold.operators.features import value_counts
from alertfold.operators.quantiles import exact_quantiles
from alertfold.schema import FEATURES, HIGH_SEVERITY, MESSAGE_LINES, MESSAGE_TAGS, PAYLOAD_REASON, REFERENCE_ZONE
from alertfold.session import stored

MIN_GATE_COUNT = 5
BASE_EXPORT = [
    "meta_id", "parent_meta_id", "agent_id", "agent_name", "rule_groups", "start_us", "end_us", "alert_count",
    "attacker_count", "ground_truth", "scenario_id",
]
DECISION_COLUMNS = ["anomaly_score", "decision", "action", "escalate"]


def scale_table(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row: map feature -> (centre, width)."""
    per = exact_quantiles(stored(value_counts(df, features), "feature-values"), [0.25, 0.5, 0.75], "feature")
    width = F.col("q")[2] - F.col("q")[0]
    entry = F.struct("feature", F.struct(
        F.col("q")[1].alias("centre"), F.when(width == 0, F.lit(1.0)).otherwise(width).alias("width")))
    return per.agg(F.map_from_entries(F.collect_list(entry)).alias("scales"))


def robust_scale(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(x - median) / IQR per feature, from exact quantiles; a zero IQR divides by one."""
    scaled = {
        f: (F.col(f).cast("double") - F.col("scales")[f]["centre"]) / F.col("scales")[f]["width"] for f in features}
    return df.crossJoin(F.broadcast(scale_table(df, features))).withColumns(scaled).drop("scales")


def normalize_scores(df: DataFrame, raw: str = "raw_score", out: str = "score") -> DataFrame:
    """Invert and map to [0, 1]; equal scores all become 0.5."""
    bounds = df.agg(F.min(-F.col(raw)).alias("_lo"), F.max(-F.col(raw)).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    unit = (-F.col(raw) - F.col("_lo")) / width
    score = F.when(width < 1e-10, F.lit(0.5)).otherwise(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, score).drop("_lo", "_hi")


def threshold(df: DataFrame, score: str = "score", method: str = "iqr", override: float | None = None) -> DataFrame:
    """One row ``theta``."""
    if override is not None:
        return df.sparkSession.range(1).select(F.lit(float(override)).alias("theta"))
    counts = stored(df.groupBy(F.col(score).cast("double").alias("value")).agg(F.count("*").alias("n")), "scores")
    if method == "iqr":
        q = exact_quantiles(counts, [0.25, 0.75])
        fence = F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
        return q.select(F.round(F.least(fence, F.lit(1.0)), 4).alias("theta"))
    if method == "percentile":
        return exact_quantiles(counts, [0.95]).select(F.round(F.col("q")[0], 4).alias("theta"))
    raise ValueError(f"unknown threshold method {method!r}")


def contamination(df: DataFrame) -> DataFrame:
    """Share of positives, kept inside [0.0001, 0.5]; 0.05 without labels. Reported only."""
    if "ground_truth" not in df.columns:
        return df.sparkSession.range(1).select(F.lit(0.05).alias("contamination"))
    share = F.avg(F.col("ground_truth").cast("double"))
    value = F.when(F.sum("ground_truth") > 0, F.least(F.greatest(share, F.lit(0.0001)), F.lit(0.5)))
    return df.agg(F.coalesce(value, F.lit(0.05)).alias("contamination"))


def false_positive_gate(score: Column, theta: Column) -> Column:
    return (
        (score >= theta) & (F.col("max_severity") < HIGH_SEVERITY) & (F.col("alert_count") < MIN_GATE_COUNT)
        & (F.col("mitre_hit_count") == 0)
    )


def decide(df: DataFrame, theta: DataFrame, score: str = "score") -> DataFrame:
    """Five decisions and three actions; the unrounded score is compared, the rounded one is kept."""
    s, t, high = F.col(score), F.col("theta"), F.col("max_severity") >= HIGH_SEVERITY
    decision = (
        F.when(false_positive_gate(s, t), "CONTEXTUAL_ANOMALY")
        .when((s >= t) & high, "CRITICAL").when(s >= t, "SUSPICIOUS")
        .when(high, "NOISE_HIGH").otherwise("NOISE")
    )
    action = (
        F.when(F.col("decision").isin("CRITICAL", "SUSPICIOUS"), "ESCALATE")
        .when(F.col("decision") == "NOISE_HIGH", "DAILY_DIGEST").otherwise("SUPPRESS")
    )
    out = df.crossJoin(F.broadcast(theta)).withColumn("decision", decision).withColumn("action", action)
    return out.withColumn("escalate", F.when(F.col("action") == "ESCALATE", 1).otherwise(0)).withColumn(
        "anomaly_score", F.round(s, 4))


def escalated(df: DataFrame) -> DataFrame:
    return df.where(F.col("escalate") == 1)


def soar_payload(scored: DataFrame) -> DataFrame:
    """Webhook body per escalated meta-alert. Two fields of the payload have no source any more and stay 0."""
    dev = F.coalesce(F.col("deviation_from_baseline"), F.lit(0.0))
    body = F.struct(
        F.col("meta_id").alias("event_id"), "anomaly_score", F.col("decision").alias("severity"),
        F.col("agent_name").alias("agent"), "rule_groups", "alert_count", "max_severity",
        F.col("mitre_hit_count").alias("mitre_hits"), F.lit(0.0).alias("rule_entropy"),
        F.lit(0.0).alias("tactic_progression"), dev.alias("baseline_deviation"), F.col("action").alias("decision"),
        F.format_string(PAYLOAD_REASON, F.col("anomaly_score"),
                        F.col("max_severity"), F.col("mitre_hit_count"), F.round(dev, 3)).alias("reason"),
    )
    return escalated(scored).select("meta_id", F.to_json(body).alias("payload"))


def notification_text(scored: DataFrame, severity_max: int = 15, zone: str = REFERENCE_ZONE, label: str = "WITA") -> DataFrame:
    """Four-line message per escalated meta-alert, with clock times in the zone that is printed."""
    clock = lambda us: F.coalesce(
        F.date_format(F.from_utc_timestamp(F.timestamp_micros(us), zone), "HH:mm"), F.lit("??:??"))
    tag = F.when(F.col("decision").isin("CRITICAL", "SUSPICIOUS"), MESSAGE_TAGS[0]).otherwise(MESSAGE_TAGS[1])
    minutes = F.greatest(F.lit(1).cast("long"), F.floor(F.col("duration_sec") / 60))
    text = F.concat_ws(
        "\n",
        F.format_string(MESSAGE_LINES[0], tag, "agent_name", "rule_groups", "decision"),
        F.format_string(MESSAGE_LINES[1], "max_severity", F.lit(severity_max),
                        "alert_count", minutes),
        F.format_string(MESSAGE_LINES[2], clock("start_us"), F.lit(label), clock("end_us"), F.lit(label)),
        F.format_string(MESSAGE_LINES[3], F.round("anomaly_score", 2)),
    )
    return escalated(scored).select("meta_id", text.alias("message"))


def scored_columns(scored: DataFrame) -> list[str]:
    return [c for c in [*BASE_EXPORT, *FEATURES, *DECISION_COLUMNS] if c in scored.columns]


def top_anomalies(scored: DataFrame, n: int = 100) -> DataFrame:
    """The report of the ``n`` strongest escalated meta-alerts."""
    return escalated(scored).orderBy(F.desc("anomaly_score"), "meta_id").limit(n).select(
        "meta_id", "agent_id", "agent_name", F.col("rule_groups").alias("rule_group"),
        F.col("max_severity").alias("severity"), "alert_count", "anomaly_score", "decision", "action")


def top_per_window(scored: DataFrame, window: Column, n: int = 10) -> DataFrame:
    """The strongest ``n`` escalated meta-alerts of every window; partial ranking happens before the shuffle."""
    best = Window.partitionBy("window_key").orderBy(F.desc("anomaly_score"), "meta_id")
    ranked = escalated(scored).withColumn("window_key", window).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= n).select(
        "window_key", "rank", "meta_id", "agent_name", "rule_groups", "max_severity", "anomaly_score", "decision")


def action_report(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("decision", "action").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "decision", "action", "n", F.round(F.col("n") / F.col("total") * 100, 4).alias("pct"))


def score_report(scored: DataFrame) -> DataFrame:
    """One row: totals, suppressed share and quantiles of the stored score."""
    suppressed = F.sum(F.when(F.col("action") == "SUPPRESS", F.col("n")).otherwise(0))
    parts = scored.groupBy("anomaly_score", "action").agg(F.count("*").alias("n"))
    q = F.percentile("anomaly_score", F.array(F.lit(0.5), F.lit(0.75)), F.col("n"))
    one = parts.agg(
        F.sum("n").alias("n_total"), F.sum(F.when(F.col("action") == "ESCALATE", F.col("n")).otherwise(0)).alias("n_escalate"),
        F.sum(F.when(F.col("action") == "DAILY_DIGEST", F.col("n")).otherwise(0)).alias("n_digest"),
        suppressed.alias("n_suppress"), F.min("anomaly_score").alias("score_min"), q.alias("q"),
        F.max("anomaly_score").alias("score_max"))
    return one.select(
        "n_total", "n_escalate", "n_digest", "n_suppress",
        F.round(F.col("n_suppress") / F.col("n_total") * 100, 2).alias("reduction_pct"),
        "score_min", F.round(F.col("q")[0], 6).alias("score_median"), F.round(F.col("q")[1], 6).alias("score_q3"),
        "score_max")


def feature_contrast(scored: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Mean of every feature relative to its largest magnitude, for escalated and other meta-alerts."""
    values = scored.select("escalate", *[F.col(f).cast("double").alias(f) for f in features])
    long = values.unpivot(["escalate"], features, "feature", "value")
    parts = long.groupBy("feature", "escalate").agg(
        F.sum("value").alias("s"), F.count("*").alias("n"), F.max(F.abs("value")).alias("m"))
    top = F.max("m").over(Window.partitionBy("feature"))
    return parts.select(
        "feature", "escalate",
        F.round(F.when(top > 0, F.col("s") / F.col("n") / top).otherwise(F.lit(0.0)), 6).alias("mean_relative"))


def score_histogram(scored: DataFrame, bins: int = 59) -> DataFrame:
    slot = F.least(F.floor(F.col("anomaly_score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy("escalate", slot.alias("bin")).agg(F.count("*").alias("n"))


def escalations_by_group(scored: DataFrame, n: int = 10) -> DataFrame:
    counts = escalated(scored).groupBy("rule_groups").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "rule_groups").limit(n)
