"""Tumbling windows, keyless bursts, look-back windows and running counts."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from alertfold.functions import scalar as X
from alertfold.operators import lookback, sessions
from alertfold.schema import MICROS, MINUTE_US


def compound_windows(alerts: DataFrame, minutes: int) -> DataFrame:
    """All activity of one agent per tumbling window, with the count of every rule group."""
    rows = sessions.with_key(alerts).withColumn("ts_us", F.unix_micros("timestamp"))
    width = minutes * MINUTE_US
    rows = rows.withColumn("window_start_us", F.floor(F.col("ts_us") / width) * width)
    has_tactic = F.coalesce(F.col("mitre_tactic"), F.lit("")) != ""
    parts = rows.groupBy("agent_id", "window_start_us", "rule_groups").agg(
        F.count("*").alias("n"), F.max("rule_level").alias("level"),
        F.sum(F.col("has_mitre").cast("long")).alias("mitre"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.min("agent_name").alias("agent_name"),
        F.collect_set(F.when(F.col("srcip") != "", F.col("srcip"))).alias("ips"),
        F.sum(F.when(has_tactic, F.size(F.split("mitre_tactic", r"\|"))).otherwise(0)).alias("n_tactics"),
    )
    entries = F.sort_array(F.collect_list(F.struct(F.col("rule_groups").alias("v"), "n")))
    ips = F.sort_array(F.array_distinct(F.flatten(F.collect_list("ips"))))
    folded = parts.groupBy("agent_id", "window_start_us").agg(
        F.min("agent_name").alias("agent_name"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.sum("n").alias("alert_count"), F.max("level").alias("max_severity"),
        F.sum("mitre").alias("mitre_hit_count"), F.count("*").alias("n_rule_groups"),
        F.sum("n_tactics").alias("n_tactics"), entries.alias("groups"), ips.alias("ips"),
    )
    return folded.select(
        "agent_id", "agent_name", "window_start_us", (F.col("window_start_us") + width).alias("window_end_us"),
        "start_us", "end_us",
        F.floor((F.col("end_us") - F.col("start_us")) / MICROS).alias("duration_sec"),
        "alert_count", "max_severity", "mitre_hit_count", "n_rule_groups", "n_tactics",
        F.size("ips").alias("attacker_count"), F.array_join("ips", "|").alias("attacker_ips"),
        X.json_counts(F.col("groups")).alias("rule_group_dist"),
    )


def compound_tactics(alerts: DataFrame, minutes: int) -> DataFrame:
    """Tactics per agent window in time order, one row each."""
    width = minutes * MINUTE_US
    named = alerts.where(F.col("mitre_tactic") != "").withColumn("ts_us", F.unix_micros("timestamp"))
    parts = named.select(
        "agent_id", (F.floor(F.col("ts_us") / width) * width).alias("window_start_us"), "ts_us", "event_id",
        F.posexplode(F.split("mitre_tactic", r"\|")))
    return parts.select("agent_id", "window_start_us", "ts_us", "event_id", F.col("pos").alias("tactic_no"),
                        F.trim("col").alias("tactic"))


def compound_attackers(alerts: DataFrame, minutes: int) -> DataFrame:
    """Source addresses per agent window with their alerts, one row each: a window may have any number of them."""
    width = minutes * MINUTE_US
    return alerts.where(F.col("srcip") != "").select(
        "agent_id", (F.floor(F.unix_micros("timestamp") / width) * width).alias("window_start_us"), "srcip",
    ).groupBy("agent_id", "window_start_us", "srcip").agg(F.count("*").alias("alert_count"))


def fixed_windows(alerts: DataFrame, minutes: int) -> DataFrame:
    """Baseline without sessions: one row per window, agent and rule group."""
    rows = sessions.with_key(alerts).withColumn("ts_us", F.unix_micros("timestamp"))
    width = minutes * MINUTE_US
    rows = rows.withColumn("window_start_us", F.floor(F.col("ts_us") / width) * width)
    keys = ["agent_id", "rule_groups", "window_start_us"]
    folded = sessions.roll_up(sessions.value_atoms(rows, keys, F.col("ts_us")).repartition(*keys), keys)
    return folded.select(
        *keys, (F.col("window_start_us") + width).alias("window_end_us"), F.col("first.txt").alias("agent_name"),
        F.col("lo_us").alias("start_us"), "end_us",
        F.floor((F.col("end_us") - F.col("lo_us")) / MICROS).alias("duration_sec"),
        "alert_count", "max_severity", "mitre_hit_count", "external_threat_count", "internal_src_count",
        "unique_rules_triggered",
        X.group_severity_code(F.col("rule_groups")).alias("rule_group_severity_enc"),
        X.agent_criticality(F.col("first.score"), F.col("first.txt")).alias("agent_criticality"),
        F.hour(F.timestamp_micros("lo_us")).alias("hour_of_day"),
        F.size("ips").alias("attacker_count"), F.array_join("ips", "|").alias("attacker_ips"),
        X.json_counts(F.col("level_entries")).alias("severity_dist"),
        X.json_counts(F.col("rule_entries")).alias("rule_id_dist"),
    )


# ---- keyless sessions and inter-arrival times ------------------------------------------------------

def global_bursts(alerts: DataFrame, gap_sec: int = 60) -> DataFrame:
    """Sessions over all alerts. Alerts are first combined per gap-wide time cell, so the one ordered window that is
    left runs over at most one row per gap of covered time, whatever the number of alerts."""
    gap = gap_sec * MICROS
    rows = alerts.withColumn("ts_us", F.unix_micros("timestamp"))
    rows = rows.withColumn("cell", F.floor(F.col("ts_us") / gap))
    pairs = rows.groupBy("cell", "agent_name", "rule_groups").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"),
        F.max("rule_level").alias("level"))
    cells = pairs.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    in_order = Window.orderBy("cell")
    opens = F.col("lo") - F.lag("hi").over(in_order) > gap
    cells = cells.withColumn("opens", F.when(F.coalesce(opens, F.lit(True)), F.col("lo")))
    cells = cells.select("cell", F.last("opens", ignorenulls=True).over(in_order).alias("start_us"))
    return pairs.join(cells, "cell").groupBy("start_us").agg(
        F.sum("n").alias("n_alerts"), F.max("hi").alias("end_us"),
        F.round((F.max("hi") - F.col("start_us")) / MICROS, 6).alias("duration_sec"),
        F.count_distinct("agent_name").alias("agents"), F.count_distinct("rule_groups").alias("groups"),
        F.max("level").alias("max_level"))


def burst_sizes(bursts: DataFrame) -> DataFrame:
    n = F.col("n_alerts")
    label = (
        F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10")
        .when(n <= 50, "11-50").when(n <= 100, "51-100").otherwise(">100")
    )
    return bursts.groupBy(label.alias("size_bin")).agg(F.count("*").alias("n_bursts"), F.sum("n_alerts").alias("n_alerts"))


def positive_gaps(alerts: DataFrame, cell_sec: int = 60) -> DataFrame:
    """Counts of the gaps between neighbouring distinct times. Gaps inside a cell come from a window per cell; gaps
    across cells come from the cells' first and last times."""
    times = alerts.select(F.unix_micros("timestamp").alias("t")).distinct()
    times = times.withColumn("cell", F.floor(F.col("t") / (cell_sec * MICROS)))
    inside = times.select((F.col("t") - F.lag("t").over(Window.partitionBy("cell").orderBy("t"))).alias("gap_us"))
    cells = times.groupBy("cell").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    across = cells.select((F.col("lo") - F.lag("hi").over(Window.orderBy("cell"))).alias("gap_us"))
    gaps = inside.unionByName(across).where(F.col("gap_us").isNotNull())
    return gaps.groupBy("gap_us").agg(F.count("*").alias("n"))


# ---- look-back windows -----------------------------------------------------------------------------

def rolling_lookback(
    alerts: DataFrame, every: int, window_sec: int, gap_minutes: int, seq: str = "event_id", cell_sec: int | None = None,
) -> DataFrame:
    """At every ``every``-th alert, sessions over the alerts of the last ``window_sec`` seconds.

    A trigger looks at its own look-back-wide time cell and the one before. An alert is sent to the cells whose triggers can
    see it, once each however many triggers they hold; a cell's triggers meet the alerts of one key there (``lookback``).
    Sessions keep the trigger in their key. ``seq`` is the alert's dense number in arrival order, from 0; should a number
    have several triggers at different times, their alerts are joined one by one.
    """
    width, gap = (cell_sec or window_sec) * MICROS, gap_minutes * MINUTE_US
    span = window_sec * MICROS
    keys = ["trigger_seq", *sessions.KEYS]
    rows = sessions.with_key(alerts).withColumn("ts_us", F.unix_micros("timestamp"))
    rows = rows.withColumn("cell", F.floor(F.col("ts_us") / width))
    triggers = rows.where(((F.col(seq) + 1) % every == 0) & F.col("ts_us").isNotNull()).groupBy(
        F.col(seq).alias("trigger_seq")).agg(
        F.min("ts_us").alias("now_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("times"))
    several = triggers.where("now_us <> last_us").select("trigger_seq")
    folded = _at_triggers(rows, triggers.where("now_us = last_us"), seq, span, width, gap)
    folded = sessions.describe(folded.withColumn("parent_start_us", F.lit(None).cast("long")), keys)
    if several.isEmpty():
        return folded
    each = rows.join(several, F.col(seq) == F.col("trigger_seq"), "left_semi").select(
        F.col(seq).alias("trigger_seq"), F.col("ts_us").alias("now_us"))
    reach = F.sequence(F.floor((F.col("now_us") - span) / width), F.floor(F.col("now_us") / width))
    seen = rows.join(each.withColumn("cell", F.explode(reach)), "cell").where(
        (F.col(seq) <= F.col("trigger_seq")) & (F.col("ts_us") >= F.col("now_us") - span))
    return folded.unionByName(sessions.fold_in_order(seen, gap, keys))


def _at_triggers(rows: DataFrame, triggers: DataFrame, seq: str, span: int, width: int, gap: int) -> DataFrame:
    """Folded sessions per trigger and key, for triggers with a number each."""
    labelled = {"is_synthetic", "scenario_id"} <= set(rows.columns)  # alerts without label columns are all real
    synthetic = F.coalesce(F.col("is_synthetic") == 1, F.lit(False)) if labelled else F.lit(False)
    known = rows.where(F.col("ts_us").isNotNull() & F.col(seq).isNotNull() & F.col("agent_id").isNotNull()
                       & F.col("rule_groups").isNotNull())
    sent = known.select(
        F.explode(F.sequence("cell", F.col("cell") + -(-span // width))).alias("home"), *sessions.KEYS, F.col(seq).cast("long").alias("seq"), "ts_us",
        "agent_name", F.col("criticality_score").cast("int").alias("criticality_score"),
        F.col("rule_level").cast("int").alias("rule_level"), F.col("rule_id").cast("int").alias("rule_id"), "srcip",
        F.col("has_mitre").cast("long").alias("mitre"), "srcip_type", synthetic.cast("int").alias("synthetic"),
        (F.when(synthetic, F.col("scenario_id")) if labelled else F.lit(None).cast("string")).alias("scenario"))
    place = ["home", *sessions.KEYS]
    asked = triggers.withColumn("home", F.floor(F.col("now_us") / width)).join(sent.select(*place).distinct(), "home")
    asked = asked.select("trigger_seq", "now_us", "times", *[F.col(c).alias(f"asked_{c}") for c in place])
    kind = T.StructType([T.StructField("trigger_seq", T.LongType()), *[rows.schema[k] for k in sessions.KEYS],
                         *T.StructType.fromDDL(lookback.FOLDED).fields])

    def fold(key: tuple, alerts: pa.Table, moments: pa.Table) -> pa.Table:
        found = lookback.sessions_at(alerts, moments, span, gap)
        for at, (name, value) in enumerate(zip(sessions.KEYS, key[1:]), 1):
            found = found.add_column(at, name, pa.repeat(value, found.num_rows))
        return found

    folded = sent.groupBy(*place).cogroup(asked.groupBy(*[f"asked_{c}" for c in place])).applyInArrow(fold, kind)
    return folded.withColumn("bucket_start_us", F.col("lo_us"))


# ---- running counts --------------------------------------------------------------------------------

def stream_counts(alerts: DataFrame) -> DataFrame:
    """Counts by agent, rule group and severity bucket, the MITRE coverage and the total, in one pass."""
    tactic = F.trim(F.coalesce(F.col("mitre_tactic"), F.lit("")))
    sides = F.array(
        F.struct(F.lit("agent").alias("dimension"), F.trim("agent_name").alias("value")),
        F.struct(F.lit("rule_group").alias("dimension"), F.trim("rule_groups").alias("value")),
        F.struct(F.lit("severity").alias("dimension"), X.severity_bucket(F.col("rule_level")).alias("value")),
        F.struct(F.lit("mitre").alias("dimension"), F.when(tactic != "", "yes").otherwise("no").alias("value")),
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
    )
    return alerts.select(F.explode(sides).alias("s")).groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"))
