"""Gap sessions and length-capped meta-alerts per ``(agent_id, rule group)``.

A row opens a session when it lies more than the gap after the newest earlier row of its key *in processing order*.
Hot keys are never gathered in one task:

* rows that are processed in time order are first combined per ``(key, time cell)`` with cells as wide as the gap. All
  rows of a cell belong to one session, so only cells have to be put in order;
* rows from the reorder scan are cut into runs inside ``(proc_block, key)`` groups, whose size is bounded by the block.

Either way what remains per key is at most one element per gap of covered time plus one per block. Those elements are
stitched with a window per key, and rows find their session through an equi-join.

A capped session is split greedily: a new bucket starts at the first newest-so-far time that lies more than the cap
after the bucket's start. That is a chain over the session's distinct newest-so-far times (``chains``).
"""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from alertfold.functions import scalar as X
from alertfold.operators import ordering as O
from alertfold.operators.adaptive import with_adaptive_gap
from alertfold.operators.chains import BLOCK_CAPS, chain_starts
from alertfold.schema import MINUTE_US

KEYS = ["agent_id", "rule_groups"]


def with_key(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("rule_groups", X.group_key(F.col("rule_groups")))


# ---- runs: the elements that are stitched into sessions -------------------------------------------

def block_runs(ordered: DataFrame, gap_us: Column | int, keys: list[str] = KEYS) -> DataFrame:
    """Cut rows in processing order into break-free runs inside every ``(proc_block, key)`` group."""
    gap = gap_us if isinstance(gap_us, Column) else F.lit(gap_us)
    w = Window.partitionBy("proc_block", *keys).orderBy(*O.RELEASE_ORDER)
    before = F.max("ts_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ordered.withColumn("ts_us", F.unix_micros("timestamp")).withColumn("gap_us", gap.cast("long"))
    rows = rows.withColumn("_before", before)
    breaks = F.col("_before").isNull() | (F.col("ts_us") - F.col("_before") > F.col("gap_us"))
    return rows.select(
        "*",
        F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run_no"),
        F.greatest("ts_us", "_before").alias("reach_us"),
        F.when(breaks, F.col("ts_us")).alias("opens_us"),
    ).drop("_before")


def cell_runs(ordered: DataFrame, gap_us: int) -> DataFrame:
    """Runs for rows in time order: the rows of one gap-wide time cell can never be apart by more than the gap."""
    ts = F.unix_micros("timestamp")
    return ordered.select(
        *[c for c in ordered.columns if c != "proc_block"],
        ts.alias("ts_us"), F.lit(gap_us).cast("long").alias("gap_us"),
        F.floor(ts / F.lit(gap_us)).alias("proc_block"), F.lit(1).cast("long").alias("run_no"), ts.alias("reach_us"),
        ts.alias("opens_us"),
    )


def stitch(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per run with the start and end of its session and the newest time before the run."""
    parts = runs.groupBy("proc_block", *keys, "run_no").agg(
        F.min("opens_us").alias("run_start"), F.max("ts_us").alias("run_end"),
        F.min(F.when(F.col("opens_us").isNotNull(), F.col("gap_us"))).alias("run_gap"),
    )
    return link(parts, keys)


def link(parts: DataFrame, keys: list[str]) -> DataFrame:
    in_order = Window.partitionBy(*keys).orderBy("proc_block", "run_no")
    newest = F.max("run_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("newest_before", newest)
    opens = F.col("newest_before").isNull() | (F.col("run_start") - F.col("newest_before") > F.col("run_gap"))
    opened = F.last(F.when(opens, F.col("run_start")), ignorenulls=True)
    parts = parts.withColumn(
        "session_start_us", opened.over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy(*keys, "session_start_us")
    return parts.withColumn("session_end_us", F.max("run_end").over(session))


# ---- rows to buckets -------------------------------------------------------------------------------

def assign_sessions(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every row with the start and end of its gap session.

    The sessions of a ``(proc_block, key)`` group are looked up as one array indexed by run number. Joining on the group
    alone lets the rows stay where the run scan placed them; the array holds at most one entry per row of a block.
    """
    place = ["proc_block", *keys]
    entry = F.struct("run_no", "session_start_us", "session_end_us", "newest_before")
    sessions = stitch(runs, keys).groupBy(*place).agg(F.sort_array(F.collect_list(entry)).alias("_sessions"))
    rows = runs.join(sessions, place).withColumn("_s", F.get("_sessions", (F.col("run_no") - 1).cast("int")))
    newest = F.when(F.col("_s.newest_before") >= F.col("_s.session_start_us"), F.col("_s.newest_before"))
    return rows.select(
        *[c for c in runs.columns if c not in ("run_no", "reach_us", "opens_us", "gap_us")],
        F.greatest("reach_us", newest).alias("reach_us"), "_s.session_start_us", "_s.session_end_us")


def newest_times(ordered: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``keys`` and ``t``: the distinct newest-so-far times of every key, for rows in processing order."""
    rows = ordered.select("proc_block", *keys, *O.RELEASE_ORDER, F.unix_micros("timestamp").alias("t"))
    w = Window.partitionBy("proc_block", *keys).orderBy(*O.RELEASE_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.max("t").over(w)).where(F.col("before").isNull() | (F.col("t") > F.col("before")))
    rows = rows.select("proc_block", *keys, "t")
    by_block = Window.partitionBy(*keys).orderBy("proc_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("proc_block", *keys).agg(F.max("t").alias("newest")).select(
        "proc_block", *keys, F.max("newest").over(by_block).alias("newest"))
    return rows.join(earlier, ["proc_block", *keys]).where(
        F.col("newest").isNull() | (F.col("t") > F.col("newest"))).select(*keys, "t")


def assign_buckets(
    ordered: DataFrame, gap_us: int | Column, cap_us: int | None = None, keys: list[str] = KEYS,
    time_ordered: bool = False, block_caps: int = BLOCK_CAPS,
) -> DataFrame:
    """Every row with ``bucket_start_us`` and, for a bucket that continues another, ``parent_start_us``.

    The bucket key ``(keys, bucket_start_us)`` is stable: it depends on the rows only.
    """
    rows = with_key(ordered)
    runs = cell_runs(rows, gap_us) if time_ordered else block_runs(rows, gap_us, keys)
    # The runs are read to build the session table and again by the rows that look themselves up.
    runs = runs.persist(StorageLevel.MEMORY_AND_DISK)
    assigned = assign_sessions(runs, keys)
    if cap_us is None:
        return assigned.select(
            "*", F.col("session_start_us").alias("bucket_start_us"), F.lit(None).cast("long").alias("parent_start_us"))
    session = [*keys, "session_start_us"]
    wide = F.col("session_end_us") - F.col("session_start_us") > cap_us
    records = assigned.where(wide).select(*session, "reach_us").distinct()
    longest_gap = runs.agg(F.max("gap_us")).first()[0] if isinstance(gap_us, Column) else gap_us
    starts = chain_starts(records, session, cap_us, longest_gap or 0, block_caps=block_caps)
    by_session = Window.partitionBy(*session).orderBy("bucket_start_us")
    starts = starts.withColumn("parent_start_us", F.lag("bucket_start_us").over(by_session))
    # Starts of one session are more than the cap apart, so a row's bucket starts in its own cap-wide cell or the
    # one before: an equi-join on the cell finds both candidates.
    cell = lambda t: F.floor((F.col(t) - F.col("session_start_us")) / F.lit(cap_us))
    at = starts.select(
        *session, cell("bucket_start_us").alias("cell"), F.struct("bucket_start_us", "parent_start_us").alias("b"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("ahead"))
    lookup = at.groupBy(*session, (F.col("cell") + F.col("ahead")).alias("cell")).agg(
        F.max(F.when(F.col("ahead") == 0, F.col("b"))).alias("own"),
        F.max(F.when(F.col("ahead") == 1, F.col("b"))).alias("prev"))
    placed = assigned.withColumn("cell", F.when(wide, cell("reach_us"))).join(lookup, [*session, "cell"], "left")
    bucket = F.when(F.col("own.bucket_start_us") <= F.col("reach_us"), F.col("own")).otherwise(F.col("prev"))
    return placed.withColumn("_b", bucket).select(
        *assigned.columns,
        F.coalesce("_b.bucket_start_us", "session_start_us").alias("bucket_start_us"),
        F.col("_b.parent_start_us").alias("parent_start_us"),
    )


# ---- buckets to meta-alerts ------------------------------------------------------------------------

VALUE = ["kind", "num", "txt", "score", "scenario"]


def value_atoms(rows: DataFrame, group: list[str], first_by: Column) -> DataFrame:
    """Counts per group and value, for three kinds of value: rule id, level (with agent, score and scenario), address.

    Only fixed-width measures are kept, so this runs as a code-generated hash aggregate that combines inside each input
    partition: a hot group leaves it as a handful of rows. ``first_by`` is a number that is smallest for the first alert.
    """
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    # Alerts without label columns are all real.
    labelled = {"is_synthetic", "scenario_id"} <= set(rows.columns)
    synthetic = F.col("is_synthetic") == 1 if labelled else F.lit(False)
    scenario = F.when(synthetic, F.col("scenario_id")) if labelled else text

    def side(kind, num, txt, score=none, scenario=text):
        return F.struct(F.lit(kind).alias("kind"), num.cast("int").alias("num"), txt.alias("txt"),
                        score.cast("int").alias("score"), scenario.alias("scenario"))

    sides = F.array(
        side("level", F.col("rule_level"), F.col("agent_name"), F.col("criticality_score"), scenario),
        side("rule", F.col("rule_id"), text),
        side("ip", none, F.when(F.col("srcip") != "", F.col("srcip"))),
    )
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    flat = rows.select(
        *group, "ts_us", first_by.alias("first_by"), F.col("has_mitre").cast("long").alias("mitre"),
        one(F.col("srcip_type") == "external").alias("external"), one(F.col("srcip_type") == "internal").alias("internal"),
        one(synthetic).alias("synthetic"), F.explode(sides).alias("side"))
    flat = flat.select("*", *[F.col(f"side.{c}").alias(c) for c in VALUE]).drop("side")
    flat = flat.where((F.col("kind") != "ip") | F.col("txt").isNotNull())
    return flat.groupBy(*group, *VALUE).agg(
        F.count("*").alias("n"), F.min("ts_us").alias("lo_us"), F.max("ts_us").alias("hi_us"),
        F.min("first_by").alias("first_by"), F.sum("mitre").alias("mitre"), F.sum("external").alias("external"),
        F.sum("internal").alias("internal"), F.max("synthetic").alias("synthetic"))


def roll_up(atoms: DataFrame, bucket: list[str]) -> DataFrame:
    """Combine value atoms into one row of measures per bucket, with both value distributions."""
    is_level, is_rule, is_ip = (F.col("kind") == k for k in ("level", "rule", "ip"))
    # Atoms of several time cells, agents or scenarios meet here; a value must appear once per bucket in its kind.
    values = atoms.groupBy(*bucket, "kind", "num", F.when(is_ip, F.col("txt")).alias("ip")).agg(
        F.sum("n").alias("n"), F.min("lo_us").alias("lo_us"), F.max("hi_us").alias("hi_us"),
        F.min(F.when(is_level, F.struct("first_by", "txt", "score"))).alias("first"),
        F.sum("mitre").alias("mitre"), F.sum("external").alias("external"), F.sum("internal").alias("internal"),
        F.max("synthetic").alias("synthetic"), F.min("scenario").alias("scenario"))
    entry = F.struct(F.col("num").cast("string").alias("v"), "n")
    total = lambda c: F.sum(F.when(is_level, F.col(c)))
    return values.groupBy(*bucket).agg(
        total("n").alias("alert_count"), F.min("lo_us").alias("lo_us"), F.max("hi_us").alias("end_us"),
        F.min("first").alias("first"), F.max(F.when(is_level, F.col("num"))).alias("max_severity"),
        F.sum(F.when(is_level, F.col("num") * F.col("n"))).alias("severity_sum"),
        total("mitre").alias("mitre_hit_count"), total("external").alias("external_threat_count"),
        total("internal").alias("internal_src_count"),
        F.count(F.when(is_rule, 1)).alias("unique_rules_triggered"),
        F.max(F.when(is_rule, F.col("n"))).alias("top_rule_count"),
        F.sort_array(F.collect_list(F.when(is_rule, entry))).alias("rule_entries"),
        F.sort_array(F.collect_list(F.when(is_level, entry))).alias("level_entries"),
        F.max("synthetic").alias("ground_truth"), F.min("scenario").alias("scenario_id"),
        F.sort_array(F.collect_list("ip")).alias("ips"),
    )


def meta_alerts(assigned: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Roll rows with a bucket up to meta-alerts. The first alert of a bucket is the first of those at its start time."""
    bucket = [*keys, "bucket_start_us", "parent_start_us"]
    first_by = F.when(F.col("ts_us") == F.col("bucket_start_us"), F.col("seq"))
    # Atoms are few per bucket, so they are placed by bucket once and both steps of the roll-up stay there.
    atoms = value_atoms(assigned, bucket, first_by).repartition(*bucket)
    return describe(roll_up(atoms, bucket), keys)


def fold_in_order(alerts: DataFrame, gap_us: int, keys: list[str] = KEYS) -> DataFrame:
    """Uncapped meta-alerts of alerts taken in time order; rows are combined per time cell before any shuffle."""
    rows = with_key(alerts).withColumn("ts_us", F.unix_micros("timestamp"))
    rows = rows.withColumn("cell", F.floor(F.col("ts_us") / F.lit(gap_us)))
    atoms = value_atoms(rows, [*keys, "cell"], F.col("ts_us"))
    # Cells of a key in order, one row per gap of covered time; a cell opens a session when it starts more than the gap
    # after the newest earlier row. Atoms, which are many where a key has many addresses, find their cell by a join.
    cells = atoms.groupBy(*keys, "cell").agg(F.min("lo_us").alias("cell_start"), F.max("hi_us").alias("cell_end"))
    in_order = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.withColumn(
        "newest_before", F.max("cell_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.col("newest_before").isNull() | (F.col("cell_start") - F.col("newest_before") > gap_us)
    opened = F.last(F.when(opens, F.col("cell_start")), ignorenulls=True)
    cells = cells.select(
        *keys, "cell", opened.over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("bucket_start_us"))
    folded = roll_up(atoms.join(cells, [*keys, "cell"]), [*keys, "bucket_start_us"])
    return describe(folded.withColumn("parent_start_us", F.lit(None).cast("long")), keys)


def describe(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Output columns of a meta-alert."""
    bucket_id = lambda start: F.concat_ws("|", *keys, start.cast("string"))
    return folded.select(
        bucket_id(F.col("bucket_start_us")).alias("meta_id"),
        F.when(F.col("parent_start_us").isNotNull(), bucket_id(F.col("parent_start_us"))).alias("parent_meta_id"),
        *keys,
        F.col("first.txt").alias("agent_name"),
        F.col("bucket_start_us").alias("start_us"), "end_us",
        F.greatest(F.lit(0).cast("long"), F.floor((F.col("end_us") - F.col("bucket_start_us")) / 1_000_000)).alias(
            "duration_sec"),
        "alert_count", "max_severity", "severity_sum",
        F.size("ips").alias("attacker_count"),
        X.group_severity_code(F.col("rule_groups")).alias("rule_group_severity_enc"),
        X.agent_criticality(F.col("first.score"), F.col("first.txt")).alias("agent_criticality"),
        F.hour(F.timestamp_micros("bucket_start_us")).alias("hour_of_day"),
        "unique_rules_triggered", "mitre_hit_count", "external_threat_count", "internal_src_count",
        F.array_join("ips", "|").alias("attacker_ips"), "top_rule_count",
        X.json_counts(F.col("level_entries")).alias("severity_dist"),
        X.json_counts(F.col("rule_entries")).alias("rule_id_dist"),
        F.to_json(F.create_map(F.col("rule_groups"), F.col("alert_count"))).alias("rule_group_dist"),
        F.coalesce("ground_truth", F.lit(0)).alias("ground_truth"),
        F.coalesce("scenario_id", F.lit("")).alias("scenario_id"),
    )


def run_meta_alerts(
    alerts: DataFrame, gap_minutes: int = 15, cap_minutes: int | None = 60, k: int = 50, lateness_sec: float = 10.0,
    block_caps: int = BLOCK_CAPS, n_blocks: int | None = None, adaptive: bool = False,
) -> DataFrame:
    """Reorder, drop what is too late, sessionize, split at the cap and roll up. With ``adaptive`` the gap follows the
    alert rate, from ``gap_minutes`` on, and every row is held to the gap in force when it is processed."""
    kept = ordered_alerts(alerts, k, lateness_sec, n_blocks)
    cap = None if cap_minutes is None else cap_minutes * MINUTE_US
    if adaptive:
        adapted = with_adaptive_gap(kept, gap_minutes)
        return meta_alerts(assign_buckets(adapted, F.col("cur_dt_us"), cap, block_caps=block_caps))
    return meta_alerts(assign_buckets(kept, gap_minutes * MINUTE_US, cap, block_caps=block_caps))


SESSION_COLUMNS = [
    "event_id", "arrival_us", "timestamp", "agent_id", "agent_name", "rule_groups", "rule_level", "rule_id", "srcip",
    "srcip_type", "has_mitre", "criticality_score", "is_synthetic", "scenario_id", "mitre_tactic",
]


def ordered_alerts(alerts: DataFrame, k: int = 50, lateness_sec: float = 10.0, n_blocks: int | None = None) -> DataFrame:
    """The kept alerts with their processing order; only the columns that sessions use cross the scan."""
    slim = alerts.select(*[c for c in SESSION_COLUMNS if c in alerts.columns])
    return O.drop_late(O.with_lateness(O.with_processing_order(slim, k, n_blocks=n_blocks), lateness_sec))


# ---- mapping ---------------------------------------------------------------------------------------

def mapping(assigned: DataFrame, alert: str = "event_id", keys: list[str] = KEYS) -> DataFrame:
    """Long form of the alert-to-bucket map."""
    return assigned.select(alert, *keys, "bucket_start_us")


def tactic_sequence(assigned: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Tactics of every bucket in processing order, one row each: order by ``seq`` and ``tactic_no``."""
    named = assigned.where(F.col("mitre_tactic") != "")
    parts = named.select(*keys, "bucket_start_us", "seq", F.posexplode(F.split("mitre_tactic", r"\|")))
    return parts.select(
        *keys, "bucket_start_us", "seq", F.col("pos").alias("tactic_no"), F.trim("col").alias("tactic")
    ).where(F.col("tactic") != "")


def validate_mapping(mapped: DataFrame, metas: DataFrame, alert: str = "event_id", keys: list[str] = KEYS) -> DataFrame:
    """One row: mapped rows, distinct alerts, overlap, count mismatches, unmatched ids on either side, verdict."""
    totals = mapped.groupBy(alert).agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_mapped"), F.count("*").alias("unique_mapped"))
    sizes = mapped.groupBy(*keys, F.col("bucket_start_us").alias("start_us")).agg(F.count("*").alias("expected"))
    sides = sizes.join(metas.select(*keys, "start_us", "alert_count"), [*keys, "start_us"], "full_outer")
    checks = sides.agg(
        F.count(F.when(F.col("expected") != F.col("alert_count"), 1)).alias("n_mismatch"),
        F.count(F.when(F.col("alert_count").isNull(), 1)).alias("only_in_map"),
        F.count(F.when(F.col("expected").isNull(), 1)).alias("only_in_metas"),
    )
    overlap = F.col("total_mapped") - F.col("unique_mapped")
    ok = (overlap == 0) & (F.col("n_mismatch") == 0) & (F.col("only_in_map") == 0) & (F.col("only_in_metas") == 0)
    return totals.crossJoin(F.broadcast(checks)).select(
        "total_mapped", "unique_mapped", overlap.alias("overlap_count"), "n_mismatch", "only_in_map", "only_in_metas",
        ok.alias("ok"))
