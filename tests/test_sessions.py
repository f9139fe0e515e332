"""Order, lateness, sessions and cap splits against sequential models, under different block counts and split paths."""

import random

import pytest
from pyspark.sql import functions as F

from alertfold.operators import adaptive, chains, ordering as O, sessions as A, windows as W
from tests import models
from tests.models import MIN

BASE = 1_704_067_200_000_000
COLUMNS = (
    "event_id long, us long, arrival_us long, agent_id string, agent_name string, rule_groups string, rule_level int, "
    "rule_id int, srcip string, srcip_type string, has_mitre int, criticality_score int, is_synthetic int, "
    "scenario_id string, mitre_tactic string"
)


def frame(spark, rows, partitions=4):
    """Alerts from ``(event, us after base, arrival, agent, group)``."""
    full = [
        (e, BASE + us, arr, agent, f"name-{agent}", group, e % 12, e % 3, "10.0.0.1" if e % 2 else "", "internal" if e % 2
         else "none", e % 2, 1, int(e % 5 == 0), "A" if e % 5 == 0 else "", "Discovery" if e % 2 else "")
        for e, us, arr, agent, group in rows
    ]
    df = spark.createDataFrame(full, COLUMNS).withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    return df.repartition(partitions)


def stream(seed, n=1500, hot=0.4, disorder=40.0):
    """Disordered alerts with ties, pauses, and one key that holds a large share of the rows."""
    rng = random.Random(seed)
    t, rows = 0, []
    for e in range(n):
        t += rng.choice([0, 0, 1, 5, 5, 20, 30]) * 1_000_000 + rng.choice([0, 0, 777])
        if rng.random() < 0.004:
            t += rng.choice([3, 8, 30]) * MIN
        late = rng.choice([0] * 20 + [int(disorder * 1e6), int(3 * disorder * 1e6)])
        agent, group = ("001", "web") if rng.random() < hot else (rng.choice(["002", "003"]), rng.choice(["web", " Syslog "]))
        rows.append((e, t, t + late, agent, group))
    return rows


def expected(rows, k, lateness, gap, cap):
    key_of = {r[0]: (r[3], r[4].strip().lower()) for r in rows}
    released = models.release([(BASE + r[1], r[2], r[0]) for r in rows], k)
    classes = models.classify(released, lateness)
    kept = [(ts, e) for ts, e, label in classes if label != "late_drop"]
    return [r[2] for r in released], {e: label for _, e, label in classes}, models.buckets(kept, gap, cap, key_of)


@pytest.mark.parametrize("seed,k,n_blocks", [(1, 50, 1), (1, 50, 7), (2, 8, 13), (3, 1, 5), (4, 400, 9), (1, 50, 100), (2, 5000, 7), (3, 1, 100)])
def test_release_order_and_lateness(spark, seed, k, n_blocks):
    rows = stream(seed, 900)
    order, classes, _ = expected(rows, k, 10_000_000, MIN, None)
    out = O.with_lateness(O.with_processing_order(frame(spark, rows), k, n_blocks=n_blocks), 10)
    got = out.orderBy("proc_block", *O.RELEASE_ORDER).collect()
    assert [r.event_id for r in got] == order
    assert {r.event_id: r.lateness for r in got} == classes
    assert sorted(r.seq for r in got) == list(range(len(rows)))


@pytest.mark.parametrize("seed,n_blocks,block_caps", [(5, 1, 64), (5, 6, 1), (6, 11, 64), (7, 4, 3), (8, 9, 2)])
def test_capped_buckets(spark, seed, n_blocks, block_caps):
    rows = stream(seed)
    _, _, want = expected(rows, 20, 20_000_000, 2 * MIN, 10 * MIN)
    kept = A.ordered_alerts(frame(spark, rows), 20, 20, n_blocks)
    got = A.assign_buckets(kept, 2 * MIN, 10 * MIN, block_caps=block_caps).collect()
    assert {r.event_id: ((r.agent_id, r.rule_groups), r.bucket_start_us, r.parent_start_us) for r in got} == want
    assert any(v[2] is not None for v in want.values())


@pytest.mark.parametrize("block_caps", [64, 1])
def test_time_ordered_buckets_equal_the_scan_on_sorted_input(spark, block_caps):
    rows = [(e, us, us, agent, group) for e, us, _, agent, group in stream(9)]
    df = frame(spark, rows)
    slow = A.assign_buckets(A.ordered_alerts(df, 20, 20, 5), 2 * MIN, 10 * MIN)
    fast = A.assign_buckets(O.in_time_order(df), 2 * MIN, 10 * MIN, time_ordered=True, block_caps=block_caps)
    pick = lambda d: {(r.event_id, r.bucket_start_us, r.parent_start_us) for r in d.collect()}
    assert pick(slow) == pick(fast)


@pytest.mark.parametrize("block_caps,gap", [(1, 90), (1, 7), (4, 25), (64, 90)])
def test_chains_of_many_blocks(spark, block_caps, gap):
    rng, rows, want = random.Random(gap), [], set()
    for group in range(5):
        first = t = rng.randrange(10**6) - 5 * 10**5
        times = []
        for _ in range([1, 40, 3000, 3000, 700][group]):
            times.append(t)
            t += rng.randrange(1, gap + 1)
        start = None
        for t in times:
            if start is None or t - start > 60:
                start = t
                want.add((f"g{group}", first, t))
        rows += [(f"g{group}", first, t) for t in times]
    records = spark.createDataFrame(rows, "g string, session_start_us long, reach_us long").repartition(3)
    got = chains.chain_starts(records, ["g", "session_start_us"], 60, gap, block_caps=block_caps).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_long_session_is_spread_over_many_blocks(spark):
    seconds, cap = 400_000, 3_600_000_000
    records = spark.range(seconds).select(F.lit("hot").alias("g"), F.lit(0).cast("long").alias("session_start_us"),
                                          (F.col("id") * 1_000_000).alias("reach_us"))
    got = sorted(r.bucket_start_us for r in chains.chain_starts(
        records, ["g", "session_start_us"], cap, 1_000_000, times_per_block=20_000).collect())
    assert got == [i * (cap + 1_000_000) for i in range(len(got))] and len(got) == -(-seconds // 3601)


def test_fold_in_order_equals_row_level_sessions(spark):
    rows = [(e, us, us, agent, group) for e, us, _, agent, group in stream(10)]
    df = frame(spark, rows)
    by_rows = A.meta_alerts(A.assign_buckets(O.in_time_order(df), 2 * MIN, time_ordered=True))
    folded = A.fold_in_order(df, 2 * MIN)
    assert {tuple(r) for r in by_rows.collect()} == {tuple(r) for r in folded.collect()}


def test_edges_of_gap_and_cap(spark):
    gap, cap = 2 * MIN, 4 * MIN
    def run(times, **kw):
        rows = [(i, t, i, "001", "web") for i, t in enumerate(times)]
        got = A.assign_buckets(A.ordered_alerts(frame(spark, rows, 1), 3, 3600), gap, kw.get("cap")).orderBy("event_id")
        return [(r.bucket_start_us - BASE, None if r.parent_start_us is None else r.parent_start_us - BASE)
                for r in got.collect()]
    assert run([0, gap]) == [(0, None), (0, None)]
    assert run([0, gap + 1]) == [(0, None), (gap + 1, None)]
    assert run([0, gap, cap], cap=cap) == [(0, None)] * 3
    assert run([0, gap, cap, cap + 1], cap=cap) == [(0, None)] * 3 + [(cap + 1, 0)]
    assert run([5]) == [(5, None)]


def test_late_row_joins_the_open_bucket_without_moving_its_start(spark):
    # k=1: released at once. Row 2 is 30 s behind row 1 and earlier than the start of the bucket of row 1.
    rows = [(0, 0, 0, "001", "web"), (1, 10 * MIN, 1, "001", "web"), (2, 10 * MIN - 30_000_000, 2, "001", "web"),
            (3, 10 * MIN - 40_000_000, 3, "009", "web")]
    kept = A.ordered_alerts(frame(spark, rows), 1, 30)
    got = {r.event_id: r.bucket_start_us - BASE for r in A.assign_buckets(kept, 2 * MIN).collect()}
    assert got == {0: 0, 1: 10 * MIN, 2: 10 * MIN, 3: 10 * MIN - 40_000_000}


def test_lateness_bounds_are_inclusive(spark):
    rows = [(0, 100_000_000, 0, "001", "web"), (1, 90_000_000, 1, "001", "web"), (2, 89_999_999, 2, "001", "web"),
            (3, 80_000_000, 3, "001", "web"), (4, 79_999_999, 4, "001", "web")]
    out = O.with_lateness(O.with_processing_order(frame(spark, rows), 1), 10)
    assert {r.event_id: r.lateness for r in out.collect()} == {
        0: "on_time", 1: "on_time", 2: "late_ok", 3: "late_ok", 4: "late_drop"}


def test_massively_tied_arrivals_still_split_into_blocks(spark):
    rows = [(e, (e * 37 % 500) * 1_000_000, 0, "001", "web") for e in range(2000)]
    df = frame(spark, rows)
    bounds = O.block_bounds(df, "arrival_us", "event_id", 8, 2000)
    assert len(bounds) == 7
    order, _, _ = expected(rows, 10, 10_000_000, MIN, None)
    out = O.with_processing_order(df, 10, n_blocks=8).orderBy("proc_block", *O.RELEASE_ORDER).collect()
    assert [r.event_id for r in out] == order


def test_empty_input(spark):
    empty = frame(spark, [(0, 0, 0, "001", "web")]).where("false")
    assert A.run_meta_alerts(empty).count() == 0
    assert A.fold_in_order(empty, MIN).count() == 0


def test_invariants_of_meta_alerts(spark):
    rows = stream(12)
    kept = A.ordered_alerts(frame(spark, rows), 20, 20, 6)
    assigned = A.assign_buckets(kept, 2 * MIN, 10 * MIN)
    metas = A.meta_alerts(assigned)
    check = A.validate_mapping(A.mapping(assigned), metas).first()
    assert check.ok and check.total_mapped == kept.count()
    assert metas.where(F.col("end_us") - F.col("start_us") > 10 * MIN).count() == 0
    ids = {r.meta_id for r in metas.collect()}
    assert all(r.parent_meta_id is None or r.parent_meta_id in ids for r in metas.collect())


@pytest.mark.parametrize("n_blocks", [1, 6])
def test_adaptive_gap(spark, n_blocks):
    rng, t, rows = random.Random(3), 0, []
    for e in range(1200):
        pace = 30 if e < 200 else 2 if e < 700 else 200
        t += int(rng.random() * pace * 1e6)
        rows.append((e, t, t, "001", "web"))
    ordered = O.with_processing_order(frame(spark, rows), 5, n_blocks=n_blocks)
    got = adaptive.with_adaptive_gap(ordered, 15).orderBy("proc_block", *O.RELEASE_ORDER).collect()
    want = models.adaptive([BASE + r[1] for r in rows], 15 * MIN)
    assert [r.event_id for r in got] == list(range(1200))
    assert max(abs(r.cur_dt_us - w) for r, w in zip(got, want)) <= 5
    assert len({round(w) for w in want}) > 3


def test_sessions_with_adaptive_gap(spark):
    rng, t, rows = random.Random(4), 0, []
    for e in range(900):
        t += int(rng.random() * (20 if e < 300 else 400) * 1e6)
        rows.append((e, t, t, rng.choice(["001", "002"]), "web"))
    ordered = adaptive.with_adaptive_gap(O.with_processing_order(frame(spark, rows), 5, n_blocks=4), 2)
    got = A.assign_buckets(ordered, F.col("cur_dt_us"), 20 * MIN).collect()
    gaps = [round(g) for g in models.adaptive([BASE + r[1] for r in rows], 2 * MIN)]
    want = models.buckets([(BASE + r[1], r[0]) for r in rows], gaps, 20 * MIN, {r[0]: (r[3], "web") for r in rows})
    assert {r.event_id: ((r.agent_id, r.rule_groups), r.bucket_start_us, r.parent_start_us) for r in got} == want


def counted(times, gap, cap):
    n, start, last = 0, None, None
    for t in times:
        if last is None or t - last > gap or (cap is not None and t - start > cap):
            n, start = n + 1, t
        last = t
    return n


@pytest.mark.parametrize("block_caps,cap", [(1, 60), (3, 60), (1024, 60), (1, None), (2, 10)])
def test_counts_under_many_gaps(spark, block_caps, cap):
    rng, groups, gaps = random.Random(block_caps), {}, [3, 9, 30, 70]
    for group in range(4):
        t = rng.randrange(-500, 500)
        for _ in range([1, 50, 2500, 2500][group]):
            groups.setdefault(f"g{group}", []).append(t)
            t += rng.randrange(1, 9) if group == 3 else rng.choice([1, 2, 2, 5, 12, 40] + [90, 4000] * (rng.random() < 0.02))
    df = spark.createDataFrame([(g, t) for g, times in groups.items() for t in times], "g string, t long").repartition(3)
    got = {r.gap_us: r.n for r in chains.chain_counts(df, ["g"], gaps, cap, block_caps).collect()}
    assert got == {gap: sum(counted(times, gap, cap) for times in groups.values()) for gap in gaps}


def test_newest_times_follow_processing_order(spark):
    rows = stream(15, 800)
    key_of = {r[0]: (r[3], r[4].strip().lower()) for r in rows}
    newest, want = {}, set()
    for ts, _, event in models.release([(BASE + r[1], r[2], r[0]) for r in rows], 8):
        if ts > newest.get(key_of[event], 0):
            newest[key_of[event]] = ts
            want.add((*key_of[event], ts))
    ordered = A.with_key(O.with_processing_order(frame(spark, rows), 8, n_blocks=6))
    got = [tuple(r) for r in A.newest_times(ordered).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("block_caps", [1, 4, 1024])
def test_mixtures_are_counted_in_one_pass(spark, block_caps):
    rng, rows = random.Random(block_caps), []
    for group in range(3):
        t = rng.randrange(500)
        for _ in range([3, 900, 2500][group]):
            level = rng.choice([0, 0, 0, 1, 2])
            rows.append((f"g{group}", t, level, int(level > 0)))
            t += rng.choice([0, 1, 2, 3] if group == 2 else [0, 1, 3, 8, 20, 45])
    df = spark.createDataFrame(rows, "g string, t long, level long, noise long").repartition(3)
    times = df.groupBy("g", "t", "level").agg(F.count("*").alias("n"), F.sum("noise").alias("noise"))
    variants = [(9, 0), (9, 1), (9, 2), (30, 2)]
    got = {r.variant: (r.n, r.absorbed) for r in chains.chain_sums(times, ["g"], variants, 60, block_caps).collect()}
    for v, (gap, most) in enumerate(variants):
        buckets = []
        for group in ("g0", "g1", "g2"):
            start = last = None
            for _, t, _, noise in sorted(r for r in rows if r[0] == group and r[2] <= most):
                if last is None or t - last > gap or t - start > 60:
                    start = t
                    buckets.append([0, 0])
                last = t
                buckets[-1][0] += 1
                buckets[-1][1] += noise
        assert got[v] == (len(buckets), sum(z for n, z in buckets if z < n)), v


def _by_pairs(alerts, every, window_sec, gap_minutes, cell_sec):
    """Look-back sessions with a row per alert and trigger that sees it."""
    width, span = cell_sec * 1_000_000, window_sec * 1_000_000
    rows = A.with_key(alerts).withColumn("ts_us", F.unix_micros("timestamp")).withColumn("cell", F.floor(F.col("ts_us") / width))
    triggers = rows.where((F.col("event_id") + 1) % every == 0).select(
        F.col("event_id").alias("trigger_seq"), F.col("ts_us").alias("now_us"), F.floor(F.col("ts_us") / width).alias("own"))
    seen = rows.join(triggers, (rows.event_id <= triggers.trigger_seq) & (rows.ts_us >= triggers.now_us - span) & (rows.cell <= triggers.own))
    return A.fold_in_order(seen.drop("cell", "own"), gap_minutes * 60_000_000, ["trigger_seq", *A.KEYS])


def _odd_alerts(spark, n, seconds, addresses, labels=True):
    """Alerts out of time order, with ties, nulls and, by every 97th, a number and time that come twice. Levels and rules are
    null only without labels: a distribution has no place for them."""
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("h"))
    rows = rows.select("event_id", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.expr(
        f"(event_id * {seconds} div {n} + h % 90) * 1000000 + h % 3")).alias("timestamp"), *[
        F.when(F.col("h") % k != 0, v).alias(name) for k, name, v in (
            (41, "agent_id", F.concat(F.lit("00"), (F.col("h") % 2).cast("string"))), (13, "agent_name", F.concat(F.lit("h"), (F.col("h") % 3).cast("string"))),
            (43, "rule_groups", F.lit("Web ")), (10**6 if labels else 7, "rule_level", (F.col("h") % 12).cast("int")), (10**6 if labels else 11, "rule_id", (F.col("h") % 15 + 95).cast("int")),
            (5, "srcip", F.when(F.col("h") % 4 > 0, F.concat(F.lit("10."), (F.col("h") % addresses).cast("string"))).otherwise("")),
            (9, "srcip_type", F.element_at(F.array(F.lit("none"), F.lit("internal"), F.lit("external")), (F.col("h") % 3 + 1).cast("int"))),
            (8, "has_mitre", (F.col("h") % 2).cast("int")), (17, "criticality_score", (F.col("h") % 4).cast("int")),
            (19, "is_synthetic", (F.col("h") % 5 == 0).cast("int")), (23, "scenario_id", F.substring(F.lit("ABC"), (F.col("h") % 3 + 1).cast("int"), F.lit(1))))])
    rows = rows.unionByName(rows.where("event_id % 97 = 0"))
    rows = rows.unionByName(rows.limit(1).withColumn("event_id", F.lit(None).cast("long")))
    rows = rows.unionByName(rows.where("event_id = 60").limit(1).withColumn("timestamp", F.lit(None).cast("timestamp")))
    return rows if labels else rows.drop("is_synthetic", "scenario_id")


@pytest.mark.parametrize("n, seconds, addresses, cell_sec, labels", [
    (3000, 20_000, 7, 600, True), (3000, 1_500, 900, 600, True), (1200, 9_000, 20, 170, False)])
def test_lookback_without_a_row_per_alert_and_trigger(spark, n, seconds, addresses, cell_sec, labels):
    alerts = _odd_alerts(spark, n, seconds, addresses, labels).localCheckpoint()
    got = W.rolling_lookback(alerts, 20, 600, 1, cell_sec=cell_sec)
    want = _by_pairs(alerts, 20, 600, 1, cell_sec)
    assert got.columns == want.columns and "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    rows = lambda df: sorted(map(str, (df if labels else df.drop("severity_dist", "rule_id_dist")).collect()))
    assert rows(got) == rows(want) and got.count() > 100


def test_lookback_triggers_of_one_number_at_several_times(spark):
    alerts = _odd_alerts(spark, 600, 3_000, 7)
    later = alerts.where("event_id in (199, 299)").withColumn("timestamp", F.col("timestamp") + F.expr("interval 8 minutes"))
    alerts = alerts.unionByName(later).localCheckpoint()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(W.rolling_lookback(alerts, 20, 600, 1)) == rows(_by_pairs(alerts, 20, 600, 1, 600))
