"""Results are whole: nothing is cut, rounded away, folded together or dropped without a count."""

from pyspark.sql import functions as F

from alertfold import schema as S
from alertfold.operators import forest, perturb as P, profile as D, sessions as A
from alertfold.sources import alerts as R, sinks as K
from alertfold.streaming import streams as ST

BASE = 1_704_067_200_000_000


def alerts(spark, n, agents=4):
    rows = spark.range(n)
    return rows.select(
        F.col("id").alias("event_id"), F.col("id").alias("arrival_us"),
        F.timestamp_micros(F.lit(BASE) + F.col("id") * 7_000_000).alias("timestamp"),
        F.concat(F.lit("evt-"), F.col("id").cast("string")).alias("wazuh_alert_id"),
        F.lpad((F.col("id") % agents).cast("string"), 3, "0").alias("agent_id"),
        F.concat(F.lit("host-"), (F.col("id") % agents).cast("string")).alias("agent_name"),
        F.element_at(F.array(F.lit("web"), F.lit("sudo"), F.lit("syslog")), (F.col("id") % 3 + 1).cast("int")).alias("rule_groups"),
        (F.col("id") % 12).cast("int").alias("rule_level"), F.lit(7).alias("rule_id"), F.lit("10.0.0.1").alias("srcip"),
        F.lit("internal").alias("srcip_type"), F.lit(0).alias("has_mitre"), F.lit(0).alias("has_critical_mitre"),
        F.lit(1).alias("criticality_score"), F.lit("").alias("mitre_tactic"))


def test_csv_rows_are_kept_or_counted(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,"x ""quoted"", and\nbroken",3\n4\n5,6,7,8\n9,,\n')
    every = R.parse_alert_csv(spark, str(path), ["a", "b", "c"])
    assert {r["reason"]: r["n"] for r in R.reject_counts(every).collect()} == {"accepted": 3, "too_many_fields": 1}
    rows = R.read_alert_csv(spark, str(path), ["a", "b", "c"])
    assert sorted(map(tuple, rows.collect())) == [("1", 'x "quoted", and\nbroken', "3"), ("4", None, None), ("9", None, None)]
    assert rows.count() == len(rows.collect()) == rows.select("a").count() == 3


def test_noise_rates_are_exact(spark):
    base = alerts(spark, 1000)
    for rate, expected in ((0.004, 4), (0.005, 5), (0.125, 125), (0.0005, 0), (1.0, 1000)):
        assert P.noise_rows(base, rate).count() == expected


def test_noise_picks_are_independent(spark):
    rows = P.noise_rows(alerts(spark, 4000), 1.0)
    assert rows.groupBy("agent_id").agg(F.count_distinct("rule_level").alias("n")).agg(F.min("n")).first()[0] == 4
    assert rows.groupBy("agent_id").agg(F.count_distinct("rule_groups").alias("n")).agg(F.min("n")).first()[0] == 3
    assert rows.select("timestamp").distinct().count() > 3900


def test_every_agent_has_its_own_rows(spark):
    got = D.month_agent_matrix(alerts(spark, 1000, agents=1000))
    assert got.count() == 1000 and got.agg(F.sum("n")).first()[0] == 1000


def test_columns_of_nulls_stay_in_the_profile(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert {(r.column_name, r.dtype, r.n_unique, r.examples) for r in D.column_profile(df, ["a", "b"]).collect()} == {
        ("a", "int", 2, "1, 2"), ("b", "string", 0, None)}


def test_mistyped_optional_fields_become_defaults(spark):
    line = '{"timestamp":"2024-01-01T00:00:00Z","rule":{"id":"1","groups":["web"]%s}%s}'
    cases = [(',"level":"9"', ""), (',"level":9.0', ""), (',"level":"high"', ""), (',"firedtimes":"3"', ""), ("", ',"data":{"audit":"x"}'),
             ("", ',"data":"x"'), ("", ',"syscheck":[]')]
    lines = [(line % c,) for c in cases] + [("[1]",), ("{broken",), ("7",)]
    parsed = R.parse_lines(spark.createDataFrame(lines, "value string"))
    assert {r["reason"]: r["n"] for r in R.reject_counts(parsed).collect()} == {"accepted": 7, "json_error": 3}
    rows = R.accepted(parsed).collect()
    assert sorted(r.rule_level for r in rows) == [0, 0, 0, 0, 0, 9, 9] and sorted(r.rule_firedtimes for r in rows) == [1] * 6 + [3]
    assert {(r.audit_command, r.syscheck_event, r.data_url) for r in rows} == {("", "", "")}


def monthly(spark, arrival):
    """Ten months, two alerts a day, in arrival order."""
    rows = spark.range(600).select(
        F.concat(F.lit("m-"), F.col("id").cast("string")).alias("wazuh_alert_id"),
        (F.timestamp_micros(F.lit(BASE)) + F.make_interval(hours=(F.col("id") * 12).cast("int"))).alias("timestamp_utc"),
        F.lit("001").alias("agent_id"), F.lit("sads").alias("agent_name"), F.lit("web").alias("rule_group_primary"),
        F.lit(3).alias("rule_level"), F.lit("5").alias("rule_id"), F.lit("10.0.0.1").alias("srcip"), F.lit("internal").alias("srcip_type"),
        F.lit(1).alias("criticality_score"), F.lit(0).alias("has_mitre"), F.lit(0).alias("has_critical_mitre"),
        *([F.col("id").alias("event_id"), (F.col("id") * 10).alias("arrival_us")] if arrival else []))
    return rows


def test_ten_months_come_back_in_arrival_order(spark, tmp_path):
    for arrival in (False, True):
        path, small = str(tmp_path / f"full-{arrival}"), str(tmp_path / f"small-{arrival}")
        K.write_monthly(monthly(spark, arrival), path, S.MINIMAL_COLUMNS, minimal_path=small)
        assert spark.read.parquet(small).count() == 600
        back = R.read_alert_parquet(spark, path).withColumnRenamed("timestamp_utc", "timestamp")
        kept = A.ordered_alerts(back, k=5, lateness_sec=60)
        assert kept.count() == 600  # nothing is late


def test_files_are_ranked_by_number(spark, tmp_path):
    for part, start in (("part-99999-x.parquet", 0), ("part-100000-x.parquet", 50)):
        frame = spark.range(start, start + 50).select(F.col("id").alias("n")).coalesce(1)
        frame.write.mode("overwrite").parquet(str(tmp_path / "one"))
        folder = tmp_path / "all" / "year=2024" / "month=2"
        folder.mkdir(parents=True, exist_ok=True)
        next((tmp_path / "one").glob("*.parquet")).rename(folder / part)
    rows = R.read_alert_parquet(spark, str(tmp_path / "all")).orderBy("arrival_us").collect()
    assert [r.n for r in rows] == list(range(100))


def test_first_arrival_of_a_copy_stays(spark, tmp_path):
    first = monthly(spark, True)
    later = first.where("event_id % 7 = 0").withColumns({
        "arrival_us": F.col("arrival_us") + 1_000_000, "event_id": F.col("event_id") + 10_000,
        "timestamp_utc": F.col("timestamp_utc") - F.expr("INTERVAL 1 DAY"), "rule_level": F.lit(9)})
    K.write_consolidated(first.unionByName(later), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 600 and back.where("rule_level = 9").count() == 0


def test_injection_makes_nothing_late(spark):
    rows = P.inject(alerts(spark, 1000), ("B", "C"), 0.01)
    assert rows.select("event_id").distinct().count() == rows.count()
    kept = A.ordered_alerts(rows, 50, 60)
    assert kept.count() == rows.count() > 1000
    assigned = A.assign_buckets(kept, 15 * 60_000_000, 60 * 60_000_000)
    labelled = P.propagate_labels(A.meta_alerts(assigned), A.mapping(assigned), rows)
    assert {r.scenario_id for r in labelled.where("ground_truth = 1").collect()} == {"B", "C"}


def test_lateness_counts_against_earlier_batches(spark):
    got = {}
    handle = ST.lateness_batches(10, lambda out, _: got.update({r.event_id: r.lateness for r in out.collect()}))
    batch = lambda ids: alerts(spark, 100).where(F.col("event_id").isin(ids))
    handle(batch([50, 49]), 0)
    handle(batch([3]), 1)
    handle(batch([51]), 2)
    handle(batch([3]), 1)  # a batch that is run again
    assert got == {50: "on_time", 49: "on_time", 3: "late_drop", 51: "on_time"}


def test_batches_leave_nothing_cached(spark):
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    handler = ST.score_batches(5, lambda metas: metas.withColumn("score", F.lit(0.1)), lambda out, _: out.count())
    spark.catalog.clearCache()
    sizes = []
    for k in range(4):
        handler(alerts(spark, 200 + k), k)
        sizes.append(cached())
    assert len(set(sizes)) == 1


def test_forest_samples_follow_one_rule(spark):
    for n in (3, 40, 100, 1000):
        rows = spark.range(n).select(F.col("id").cast("string").alias("meta_id"), F.col("id").cast("double").alias("x"))
        samples, size = forest.tree_samples(rows, ["x"], trees=10, subsample=20, seed=1, key="meta_id")
        per_tree = samples.groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct("_key").alias("d")).collect()
        assert size == min(20, n) and len(per_tree) == 10 and {(r.n, r.d) for r in per_tree} == {(size, size)}
        uses = samples.groupBy("_key").count().agg(F.max("count"), F.min("count")).first()
        assert uses[0] - uses[1] <= 1 and samples.select("_key").distinct().count() == min(n, 200)
