"""The eleven features of a meta-alert."""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from alertfold.functions import scalar as X
from alertfold.operators.quantiles import exact_quantiles
from alertfold.schema import DAY_S, FEATURES, MICROS
from alertfold.session import stored

DEVIATION_CLIP = 5.0


def alert_count_log(metas: DataFrame) -> DataFrame:
    n = F.greatest(X.numeric_or(F.col("alert_count"), 1), F.lit(1.0))
    return metas.withColumn("alert_count_log", F.round(F.log1p(n), 4))


def alert_velocity(metas: DataFrame) -> DataFrame:
    n = F.greatest(X.numeric_or(F.col("alert_count"), 1), F.lit(0.0))
    seconds = F.greatest(X.numeric_or(F.col("duration_sec"), 0), F.lit(1.0))
    return metas.withColumn("alert_velocity", F.round(n / seconds, 4))


def _counts(json: Column) -> Column:
    return F.from_json(json, "map<string,bigint>")


def concentration_of(json: Column) -> Column:
    """Share of the most frequent value of a stored JSON distribution; empty or unreadable text gives 1."""
    values = F.map_values(_counts(json))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    return F.coalesce(F.when(total > 0, F.round(F.array_max(values) / total, 4)), F.lit(1.0))


def spread_of(max_severity: Column, json: Column) -> Column:
    """Highest level minus the mean level of a stored JSON distribution."""
    entries = F.map_entries(_counts(json))
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    weighted = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["key"].try_cast("long") * e["value"])
    mean = F.coalesce(F.when(total > 0, weighted / total), F.lit(0.0))
    return F.round(F.greatest(X.numeric_or(max_severity, 0) - mean, F.lit(0.0)), 4)


def rule_concentration(metas: DataFrame) -> DataFrame:
    if "top_rule_count" in metas.columns:
        share = F.round(F.col("top_rule_count") / F.col("alert_count"), 4)
    elif "rule_id_dist" in metas.columns:
        share = concentration_of(F.col("rule_id_dist"))
    else:
        share = F.lit(1.0)
    return metas.withColumn("rule_concentration", share)


def severity_spread(metas: DataFrame) -> DataFrame:
    if "severity_sum" in metas.columns:
        spread = F.round(F.greatest(
            F.col("max_severity") - F.col("severity_sum") / F.col("alert_count"), F.lit(0.0)), 4)
    elif "severity_dist" in metas.columns:
        spread = spread_of(F.col("max_severity"), F.col("severity_dist"))
    else:
        spread = F.lit(0.0)
    return metas.withColumn("severity_spread", spread)


def deviation_from_baseline(metas: DataFrame, key: str = "agent_name") -> DataFrame:
    """``(count - mean) / mean`` against the same agent's meta-alerts that started in ``[t - 24 h, t)``.

    Times have a grain of one second. With ``o`` the second within the day, the look-back is the part of the previous
    day from ``o`` on plus the part of the current day before ``o``: two running sums inside ``(agent, day)`` groups,
    which never hold more than two rows per second. No range frame is recomputed per row.
    """
    second = F.floor(F.col("start_us") / MICROS)
    seconds = metas.groupBy(F.col(key).alias("k"), second.alias("s")).agg(
        F.sum("alert_count").alias("a"), F.count("*").alias("c"))
    day, o = F.floor(F.col("s") / DAY_S), F.col("s") % DAY_S
    here = seconds.select("k", day.alias("day"), o.alias("o"), "s", "a", "c", F.lit(True).alias("same_day"))
    zero = F.lit(0).cast("long")
    back = seconds.select("k", (day - 1).alias("day"), o.alias("o"), "s", zero.alias("a"), zero.alias("c"),
                          F.lit(False).alias("same_day"))
    in_day = Window.partitionBy("k", "day").orderBy("o")
    before = in_day.rangeBetween(Window.unboundedPreceding, -1)
    whole = in_day.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = here.unionByName(back).select(
        "k", "s",
        F.when(F.col("same_day"), part("a")).otherwise(F.sum("a").over(whole) - part("a")).alias("a"),
        F.when(F.col("same_day"), part("c")).otherwise(F.sum("c").over(whole) - part("c")).alias("c"))
    base = sums.groupBy("k", "s").agg(F.sum("a").alias("base_sum"), F.sum("c").alias("base_n"))
    joined = metas.withColumn("_s", second).join(
        base, (F.col(key) == F.col("k")) & (F.col("_s") == F.col("s")), "left")
    mean = F.when(F.col("base_n") > 0, F.col("base_sum") / F.col("base_n"))
    deviation = F.when(mean > 0, (F.col("alert_count") - mean) / mean).otherwise(F.lit(0.0))
    clipped = F.least(F.greatest(deviation, F.lit(-DEVIATION_CLIP)), F.lit(DEVIATION_CLIP))
    return joined.select(*[metas[c] for c in metas.columns], F.round(clipped, 4).alias("deviation_from_baseline"))


def normalize_core(metas: DataFrame) -> DataFrame:
    """Fill and bound the features that arrive with the meta-alert."""
    has = set(metas.columns)
    cols = {
        "duration_sec": F.greatest(F.col("duration_sec"), F.lit(0)),
        "rule_groups": X.group_key(F.col("rule_groups")),
        "rule_group_severity_enc": F.col("rule_group_severity_enc") if "rule_group_severity_enc" in has
        else X.group_severity_code(F.col("rule_groups")),
        "agent_criticality": F.least(F.greatest(X.numeric_or(F.col("agent_criticality"), 1, "int"), F.lit(1)), F.lit(4))
        if "agent_criticality" in has else X.agent_score_by_name(F.col("agent_name")),
        "hour_of_day": F.col("hour_of_day") if "hour_of_day" in has else F.hour(F.timestamp_micros("start_us")),
        "mitre_hit_count": X.numeric_or(F.col("mitre_hit_count"), 0, "long") if "mitre_hit_count" in has
        else F.lit(0).cast("long"),
    }
    return metas.withColumns(cols)


def enrich(metas: DataFrame, kept: list[DataFrame] | None = None) -> DataFrame:
    """All eleven features.

    The baseline joins the meta-alerts to sums over themselves, so they are kept: the raw alerts are folded once. The kept
    frame is added to ``kept``, for callers that go on afterwards and release it.
    """
    df = normalize_core(metas).persist(StorageLevel.MEMORY_AND_DISK)
    if kept is not None:
        kept.append(df)
    for step in (alert_count_log, alert_velocity, rule_concentration, severity_spread, deviation_from_baseline):
        df = df.transform(step)
    return df


def guard_types(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Every feature as a number: absent, null or unreadable becomes 0."""
    return df.withColumns({
        f: X.numeric_or(F.col(f), 0) if f in df.columns else F.lit(0.0) for f in features})


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, value, n)``: the compact form from which exact quantiles are taken."""
    wide = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    long = wide.unpivot([], features, "feature", "value")
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def feature_summary(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    counts = stored(value_counts(df, features), "feature-values")
    stats = counts.groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n_unique"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    stats = stats.join(F.broadcast(exact_quantiles(counts, [0.25, 0.5, 0.75], "feature")), "feature", "left")
    rounded = lambda c: F.round(c, 6)
    return stats.select(
        "feature", "min", "max", "n_unique", rounded(F.col("q")[0]).alias("q1"), rounded(F.col("q")[1]).alias("median"),
        rounded(F.col("q")[2]).alias("q3"), rounded(F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        F.round("mean", 4).alias("mean"))
