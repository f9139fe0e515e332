"""Profiling tables of an alert data set."""

from pyspark.sql import DataFrame, Window, functions as F

from alertfold import schema as S
from alertfold.functions import scalar as X
from alertfold.operators.quantiles import exact_quantiles
from alertfold.operators.windows import positive_gaps
from alertfold.schema import MICROS
from alertfold.session import stored


def with_calendar(alerts: DataFrame, zone: str = S.REFERENCE_ZONE) -> DataFrame:
    return alerts.withColumns(X.local_calendar(F.col("timestamp"), zone))


def _with_share(counts: DataFrame, name: str = "pct", digits: int = 4) -> DataFrame:
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn(
        name, F.round(F.col("n") / F.col("_total") * 100, digits)).drop("_total")


def overview(alerts: DataFrame) -> DataFrame:
    """One row of totals; distinct values are counted through per-column groups, not collected."""
    ts = F.unix_micros("timestamp")
    n_columns = len(alerts.columns)
    return with_calendar(alerts).agg(
        F.count("*").alias("n_alerts"), F.lit(n_columns).alias("n_columns"), F.min(ts).alias("first_us"),
        F.max(ts).alias("last_us"), F.count_distinct("local_date").alias("n_days"),
        F.count_distinct("agent_name").alias("n_agents"), F.count_distinct("rule_groups").alias("n_groups"),
        F.count_distinct("rule_id").alias("n_rules"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column with a flag above one half."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pct = F.when(F.col("_n") > 0, F.col("n_null") / F.col("_n") * 100).otherwise(F.lit(0.0))
    return one.unpivot(["_n"], columns, "column_name", "n_null").select(
        "column_name", "n_null", F.round(pct, 1).alias("pct"), F.when(pct > 50, 1).otherwise(0).alias("mostly_null"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Type, number of distinct values and the three smallest values of each column, as text; a column with nulls only
    has 0 distinct values and no examples."""
    types = X.literal_map({n: t for n, t in df.dtypes if n in columns})
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    values = text.unpivot([], columns, "column_name", "value").where(F.col("value").isNotNull()).distinct()
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("value")))
    heads = ranked.where(F.col("r") <= 3).groupBy("column_name").agg(
        F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("examples"))
    found = values.groupBy("column_name").agg(F.count("*").alias("n_unique")).join(heads, "column_name")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")  # also columns without values
    return every.join(found, "column_name", "left").select(
        "column_name", types[F.col("column_name")].alias("dtype"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        "examples")


def daily_volume(alerts: DataFrame) -> DataFrame:
    """Alerts per local day with the centred mean over seven days that have data."""
    days = with_calendar(alerts).groupBy("local_date").agg(F.count("*").alias("n"))
    around = Window.orderBy("local_date").rowsBetween(-3, 3)
    mean = F.when(F.count("*").over(around) == 7, F.round(F.avg("n").over(around), 4))
    return days.select(F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), "n", mean.alias("rolling7"))


def daily_stats(alerts: DataFrame) -> DataFrame:
    days = with_calendar(alerts).groupBy("local_date").agg(F.count("*").alias("n"))
    day = F.date_format("local_date", "yyyy-MM-dd")
    one = days.agg(
        F.count("*").alias("n_days"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_samp("n"), 4).alias("std"),
        F.min("n").alias("min"), F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max("n").alias("max"), F.min_by(day, F.struct("n", "local_date")).alias("quietest_day"),
        F.min_by(day, F.struct(-F.col("n"), "local_date")).alias("busiest_day"))
    return one.select("n_days", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                      F.col("q")[2].alias("q3"), "max", "quietest_day", "busiest_day")


def day_hour_matrix(alerts: DataFrame) -> DataFrame:
    rows = with_calendar(alerts).groupBy("day_of_week").pivot("local_hour", list(range(24))).count().na.fill(0)
    return rows.select("day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def hourly_totals(alerts: DataFrame) -> DataFrame:
    hours = with_calendar(alerts).groupBy("local_hour").agg(F.count("*").alias("n"))
    busiest = hours.agg(F.min_by("local_hour", F.struct(-F.col("n"), "local_hour")).alias("b"))
    return hours.crossJoin(F.broadcast(busiest)).select(
        "local_hour", "n", F.when(F.col("local_hour") == F.col("b"), 1).otherwise(0).alias("busiest"))


def iat_stats(alerts: DataFrame) -> DataFrame:
    """One row on the positive inter-arrival times."""
    sec = F.col("gap_us") / MICROS
    share = lambda limit: F.round(F.sum(F.when(sec < limit, F.col("n")).otherwise(0)) / F.sum("n") * 100, 4)
    gaps = stored(positive_gaps(alerts), "gaps")
    median = exact_quantiles(gaps, [0.5], value="gap_us").first().q
    return gaps.agg(
        F.sum("n").alias("n_gaps"), F.round(F.lit(median[0] if median else None).cast("double") / MICROS, 6).alias("median_sec"),
        F.round(F.sum(F.col("gap_us") * F.col("n")) / F.sum("n") / MICROS, 6).alias("mean_sec"),
        *[share(limit).alias(f"pct_lt_{limit}s") for limit in (1, 5, 60, 300, 900)])


def iat_histogram(alerts: DataFrame, bins: int = 60, upper_sec: int = 60) -> DataFrame:
    """Linear histogram of gaps up to ``upper_sec``."""
    width = upper_sec * MICROS // bins
    return positive_gaps(alerts).where(F.col("gap_us") <= upper_sec * MICROS).groupBy(
        F.least(F.floor(F.col("gap_us") / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def iat_log_histogram(alerts: DataFrame) -> DataFrame:
    """Gaps per decade of microseconds: digits of an integer, so that no rounding decides a bin."""
    return positive_gaps(alerts).groupBy(
        (F.length(F.col("gap_us").cast("string")) - 7).alias("log10_sec")).agg(F.sum("n").alias("n"))


def agent_profile(alerts: DataFrame) -> DataFrame:
    level = F.col("rule_level")
    stats = alerts.groupBy("agent_name").agg(
        F.count("*").alias("n"), F.round(F.avg(level), 4).alias("avg_level"), F.max(level).alias("max_level"),
        F.round(F.avg("has_mitre") * 100, 4).alias("mitre_pct"),
        F.round(F.avg("has_critical_mitre") * 100, 4).alias("critical_mitre_pct"),
        F.count_distinct("rule_groups").alias("n_rule_groups"), F.count_distinct("rule_id").alias("n_rule_ids"),
        F.max("criticality_score").alias("criticality"))
    return _with_share(stats)


def month_agent_matrix(alerts: DataFrame) -> DataFrame:
    """Alerts per month and agent in long form, for any number of agents."""
    return with_calendar(alerts).groupBy("month", "agent_name").agg(F.count("*").alias("n"))


def group_share(alerts: DataFrame) -> DataFrame:
    counts = _with_share(alerts.groupBy("rule_groups").agg(F.count("*").alias("n")))
    rank = Window.orderBy(F.desc("n"), "rule_groups")
    return counts.withColumn("rank", F.row_number().over(rank))


def level_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per level with the running share: at most 16 rows after the aggregate."""
    counts = _with_share(alerts.groupBy("rule_level").agg(F.count("*").alias("n")))
    upto, every = Window.orderBy("rule_level"), Window.partitionBy()
    return counts.withColumn("cum_pct", F.round(F.sum("n").over(upto) / F.sum("n").over(every) * 100, 4))


def zone_share(alerts: DataFrame) -> DataFrame:
    zone = X.severity_zone(F.col("rule_level"))
    return _with_share(alerts.groupBy(zone.alias("zone")).agg(F.count("*").alias("n")))


def _agent_group_counts(alerts: DataFrame, top: int) -> DataFrame:
    counts = alerts.groupBy("agent_name", "rule_groups").agg(F.count("*").alias("n"))
    heads = counts.groupBy("rule_groups").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "rule_groups").limit(top)
    return counts.join(F.broadcast(heads.select("rule_groups")), "rule_groups", "left_semi")


def agent_group_matrix(alerts: DataFrame, top: int = 12) -> DataFrame:
    """Long-form agent by group counts with the row share."""
    by_agent = Window.partitionBy("agent_name")
    return _agent_group_counts(alerts, top).select(
        "agent_name", "rule_groups", "n", F.round(F.col("n") / F.sum("n").over(by_agent) * 100, 4).alias("row_pct"))


def dominant_group(alerts: DataFrame, top: int = 12) -> DataFrame:
    counts = _agent_group_counts(alerts, top)
    return counts.groupBy("agent_name").agg(
        F.min_by("rule_groups", F.struct(-F.col("n"), "rule_groups")).alias("top_group"),
        F.round(F.max("n") / F.sum("n") * 100, 4).alias("pct"))


def tactic_profile(alerts: DataFrame) -> DataFrame:
    parts = alerts.where(F.col("mitre_tactic") != "").select(F.explode(F.split("mitre_tactic", r"\|")).alias("t"))
    rows = parts.select(F.trim("t").alias("tactic")).where(F.col("tactic") != "")
    critical = F.when(F.col("tactic").isin(S.CRITICAL_TACTICS), 1).otherwise(0)
    return rows.groupBy("tactic").agg(F.count("*").alias("n")).withColumn("critical", critical)


def mitre_coverage(alerts: DataFrame) -> DataFrame:
    """MITRE share per agent and overall (agent ``*``)."""
    parts = alerts.groupBy("agent_name").agg(
        F.count("*").alias("n"), F.sum(F.col("has_mitre").cast("long")).alias("m"),
        F.sum(F.col("has_critical_mitre").cast("long")).alias("c"))
    total = parts.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("c").alias("c")).withColumn(
        "agent_name", F.lit("*"))
    pct = lambda c: F.round(F.col(c) / F.col("n") * 100, 4)
    return parts.unionByName(total).select(
        "agent_name", "n", F.col("m").alias("n_mitre"), F.col("c").alias("n_critical"),
        pct("m").alias("mitre_pct"), pct("c").alias("critical_pct"))


def srcip_types(alerts: DataFrame) -> DataFrame:
    return _with_share(alerts.groupBy("srcip_type").agg(F.count("*").alias("n")))


def agent_srcip_matrix(alerts: DataFrame) -> DataFrame:
    kinds = ["external", "internal", "none"]
    return alerts.groupBy("agent_name").pivot("srcip_type", kinds).count().na.fill(0)


def subnet_counts(alerts: DataFrame) -> DataFrame:
    internal = alerts.where(F.col("srcip_type") == "internal")
    return internal.groupBy(X.subnet24(F.col("srcip")).alias("subnet")).agg(F.count("*").alias("n"))


def shared_ips(alerts: DataFrame) -> DataFrame:
    """Internal addresses seen on more than one agent, with the agents in order."""
    pairs = alerts.where(F.col("srcip_type") == "internal").groupBy("srcip", "agent_name").agg(F.count("*").alias("n"))
    return pairs.groupBy("srcip").agg(
        F.count("*").alias("n_agents"), F.sum("n").alias("n_alerts"),
        F.array_join(F.sort_array(F.collect_list("agent_name")), "|").alias("agents")).where(F.col("n_agents") > 1)


def rule_profile(alerts: DataFrame, order: tuple[str, ...] = ("arrival_us", "event_id")) -> DataFrame:
    first = F.min_by("rule_groups", F.struct(*order))
    stats = alerts.groupBy("rule_id").agg(
        F.count("*").alias("n"), F.round(F.avg("rule_level"), 4).alias("avg_level"),
        F.max("rule_level").alias("max_level"), first.alias("first_group"),
        *([F.min_by("rule_description", F.struct(*order)).alias("description")] if "rule_description" in alerts.columns else []),
        F.round(F.avg("has_mitre"), 4).alias("mitre_rate"), F.count_distinct("agent_name").alias("n_agents"))
    return _with_share(stats)


def agent_rule_repeats(alerts: DataFrame, k: int = 30, order: tuple[str, ...] = ("arrival_us", "event_id")) -> DataFrame:
    stats = alerts.groupBy("agent_name", "rule_id").agg(
        F.count("*").alias("n"), F.min_by("rule_groups", F.struct(*order)).alias("first_group"),
        F.min_by("rule_level", F.struct(*order)).alias("first_level"))
    return stats.orderBy(F.desc("n"), "agent_name", "rule_id").limit(k)


def session_profile(metas: DataFrame) -> DataFrame:
    sizes = metas.groupBy("alert_count").agg(F.count("*").alias("n"))
    n, c = F.col("n"), F.col("alert_count")
    return sizes.agg(
        F.sum("n").alias("n_meta"), F.round(F.sum(c * n) / F.sum(n), 4).alias("avg_alerts"),
        F.percentile("alert_count", 0.5, F.col("n")).alias("median_alerts"), F.max(c).alias("max_alerts"),
        F.round(F.sum(F.when(c == 1, n).otherwise(0)) / F.sum(n) * 100, 4).alias("singleton_pct"))


def agent_reduction(alerts: DataFrame, metas: DataFrame) -> DataFrame:
    raw = alerts.groupBy("agent_name").agg(F.count("*").alias("n_raw"))
    folded = metas.groupBy("agent_name").agg(F.count("*").alias("n_meta"))
    return raw.join(folded, "agent_name", "left").na.fill(0).select(
        "agent_name", "n_raw", "n_meta",
        F.round(X.reduction_rate(F.col("n_meta"), F.col("n_raw")), 4).alias("arr_pct"))


def duration_histogram(metas: DataFrame, width_min: int = 5) -> DataFrame:
    return metas.groupBy(F.floor(F.col("duration_sec") / (width_min * 60)).alias("bin")).agg(F.count("*").alias("n"))


CORRELATED = ["rule_level", "criticality_score", "has_mitre", "has_critical_mitre", "group_enc"]


def _numeric(alerts: DataFrame) -> DataFrame:
    """Combine to one row per combination of the five small-domain columns before any statistic is taken."""
    df = alerts.withColumn("group_enc", X.group_severity_code(F.col("rule_groups")))
    return df.groupBy(*CORRELATED).agg(F.count("*").alias("n"))


def correlation(alerts: DataFrame) -> DataFrame:
    """Pearson correlation of every pair, from exact integer sums."""
    cells = _numeric(alerts)
    pairs = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]]
    s = lambda e: F.sum(e * F.col("n")).cast("double")
    sums = cells.agg(
        F.sum("n").cast("double").alias("n"), *[s(F.col(c)).alias(f"s_{c}") for c in CORRELATED],
        *[s(F.col(c) * F.col(c)).alias(f"q_{c}") for c in CORRELATED],
        *[s(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for a, b in pairs])
    n = F.col("n")

    def r(a, b):
        spread = lambda c: n * F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}")
        both = n * F.col(f"p_{a}__{b}") - F.col(f"s_{a}") * F.col(f"s_{b}")
        size = F.sqrt(spread(a)) * F.sqrt(spread(b))
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.when(size > 0, F.round(both / size, 6)).alias("r"))

    return sums.select(F.explode(F.array(*[r(a, b) for a, b in pairs])).alias("c")).select("c.*")


def moments(alerts: DataFrame) -> DataFrame:
    """Mean, deviation, range, bias-corrected skew and share of zeros per numeric column."""
    long = _numeric(alerts).unpivot(["n"], CORRELATED, "column_name", "v")
    n, v = F.col("n"), F.col("v").cast("double")
    sums = long.groupBy("column_name").agg(
        F.sum(n).cast("double").alias("n"), F.sum(v * n).alias("s1"), F.sum(v * v * n).alias("s2"),
        F.sum(v * v * v * n).alias("s3"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.sum(F.when(F.col("v") == 0, n).otherwise(0)).alias("zeros"))
    N, mean = F.col("n"), F.col("s1") / F.col("n")
    m2 = F.col("s2") / N - mean * mean
    m3 = F.col("s3") / N - 3 * mean * F.col("s2") / N + 2 * mean * mean * mean
    skew = F.when((N > 2) & (m2 > 1e-12), F.sqrt(N * (N - 1)) / (N - 2) * m3 / F.pow(m2, F.lit(1.5)))
    return sums.select(
        "column_name", F.round(mean, 4).alias("mean"), F.round(F.sqrt(m2 * N / (N - 1)), 4).alias("std"), "min", "max",
        F.round(skew, 4).alias("skew"), F.round(F.col("zeros") / N * 100, 4).alias("zero_pct"))


def high_severity_pairs(alerts: DataFrame, level: int = 10, k: int = 20) -> DataFrame:
    stats = alerts.where(F.col("rule_level") >= level).groupBy("agent_name", "rule_groups").agg(
        F.count("*").alias("n"), F.max("rule_level").alias("max_level"),
        F.max("criticality_score").alias("criticality"))
    return stats.orderBy(F.desc("criticality"), F.desc("n"), "agent_name", "rule_groups").limit(k)


def group_summary(alerts: DataFrame) -> DataFrame:
    stats = alerts.groupBy("rule_groups").agg(
        F.count("*").alias("n"), F.round(F.avg("rule_level"), 4).alias("avg_level"),
        F.round(F.avg("has_mitre") * 100, 4).alias("mitre_pct"))
    return stats.withColumns({
        "enc": X.group_severity_code(F.col("rule_groups")),
        "uses_default": F.when(X.group_is_mapped(F.col("rule_groups")), 0).otherwise(1)})


def encoded_level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(X.group_severity_code(F.col("rule_groups")).alias("enc")).agg(F.count("*").alias("n"))


def quality_flags(alerts: DataFrame) -> DataFrame:
    """One row: single-day bias, agent dominance above 30 %, group imbalance above 50 %, distinct scores."""
    day = F.to_date("timestamp")
    days = alerts.select(day.alias("d")).distinct().agg(F.count("*").alias("n_days"))
    agents = alerts.groupBy("agent_name").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n_alerts"), F.max("n").alias("top"), F.min_by("agent_name", F.struct(
            -F.col("n"), "agent_name")).alias("top_agent"))
    groups = alerts.groupBy("rule_groups").agg(F.count("*").alias("n")).agg(
        F.max("n").alias("top_g"), F.min_by("rule_groups", F.struct(-F.col("n"), "rule_groups")).alias("top_group"))
    one = agents.crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(days))
    share = lambda c: F.col(c) / F.col("n_alerts") * 100
    return one.select(
        "n_alerts", "n_days", F.when(F.col("n_days") <= 1, 1).otherwise(0).alias("single_day"),
        "top_agent", F.round(share("top"), 4).alias("top_agent_pct"),
        F.when(share("top") > 30, 1).otherwise(0).alias("agent_dominates"),
        "top_group", F.round(share("top_g"), 4).alias("top_group_pct"),
        F.when(share("top_g") > 50, 1).otherwise(0).alias("group_imbalance"))


def criticality_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("criticality_score").agg(F.count("*").alias("n"))


def anomaly_levels(scored: DataFrame) -> DataFrame:
    """Meta-alerts per severity with the escalated share."""
    stats = scored.groupBy("max_severity").agg(
        F.count("*").alias("n"), F.sum(F.col("escalate").cast("long")).alias("n_escalated"))
    return stats.withColumn("escalated_pct", F.round(F.col("n_escalated") / F.col("n") * 100, 4))


def anomalous_agents(scored: DataFrame, k: int = 5) -> DataFrame:
    counts = scored.where(F.col("escalate") == 1).groupBy("agent_name").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "agent_name").limit(k)
