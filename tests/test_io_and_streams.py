"""Ingest, sinks and streams on small inputs."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from alertfold import schema as S
from alertfold.functions import scalar as X
from alertfold.operators import clean, decide as M, profile as D, sessions as A
from alertfold.sources import alerts as R, sinks as K
from alertfold.streaming import streams as ST
from tests.models import MIN
from tests.test_sessions import BASE, frame, stream


def record(**over):
    base = {"timestamp": "2024-01-01T08:00:00.5+08:00", "id": "1.2", "agent": {"id": "12", "name": "sads"},
            "rule": {"id": "55", "level": 9, "groups": ["local", "web", "pam"], "mitre": {"tactic": ["Execution"]}},
            "data": {"srcip": "172.17.0.9"}, "full_log": "z" * 400}
    base.update(over)
    return json.dumps(base)


def test_parse_and_reject(spark):
    lines = [record(), "   ", "{broken", record(timestamp=""), record(timestamp="yesterday-ish"),
             record(rule={"groups": ["a"]}), record(rule={"id": "1", "groups": []}), record(agent={"id": "12345"})]
    parsed = R.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    counts = {r.reason: r.n for r in R.reject_counts(parsed).collect()}
    assert counts == {"accepted": 2, **{reason: 1 for reason in R.REJECT_REASONS}}
    first, second = R.accepted(parsed).orderBy("agent_id").collect()
    assert (first.agent_id, second.agent_id) == ("012", "12345")
    assert first.timestamp_utc.isoformat() == "2024-01-01T00:00:00.500000"
    assert (first.rule_group_primary, first.srcip_type, first.criticality_score) == ("web", "internal", 3)
    assert (first.has_mitre, first.has_critical_mitre, first.mitre_tactic) == (1, 1, "Execution")
    assert len(first.full_log) == 400 and second.agent_name == "unknown"
    assert R.rejected(parsed).count() == 6


def test_primary_group_edges(spark):
    df = spark.createDataFrame([([],), (["x", "y"],), (["pam", "web"],), (["ossec", "attack"],)], "g array<string>")
    got = [r[0] for r in df.select(X.primary_group(F.col("g"))).collect()]
    assert got == ["unknown", "x", "pam", "attack"]


def test_srcip_prefixes(spark):
    ips = {"172.16.1.1": "internal", "172.17.1.1": "internal", "172.18.1.1": "external", "127.0.0.1": "internal",
           "8.8.8.8": "external", "": "none"}
    df = spark.createDataFrame([(k,) for k in ips], "ip string").select("ip", X.srcip_type(F.col("ip")).alias("t"))
    assert {r.ip: r.t for r in df.collect()} == ips


def test_csv_with_bad_lines_and_absent_columns(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("timestamp_utc,agent_id,agent_name,rule_group_primary,rule_level\n"
                    "2024-01-01 00:00:00,7,sads, WEB ,3\nonly,two\n2024-01-01 00:00:01,sha1,sads,web,3\n")
    columns = ["timestamp_utc", "agent_id", "agent_name", "rule_group_primary", "rule_level"]
    out = clean.clean_alerts(R.read_alert_csv(spark, str(path), columns)).collect()
    assert [(r.rule_groups, r.srcip, r.srcip_type, r.rule_id, r.criticality_score, r.has_mitre) for r in out] == [
        ("web", "", "none", 0, 1, 0)]


def test_monthly_and_consolidated_sinks(spark, tmp_path):
    lines = [record(id=str(i), timestamp=f"2024-0{1 + i % 2}-03T00:00:0{i % 10}Z") for i in range(20)] + [record(id="3")]
    stored = R.accepted(R.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    K.write_monthly(stored, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m" / "year=2024").iterdir()} == {"month=1", "month=2"}
    K.write_consolidated(spark.read.parquet(str(tmp_path / "m")).drop("year", "month"), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 20 and set(back.columns) == set(S.FULL_COLUMNS)


def test_from_raw_lines_to_meta_alerts(spark, tmp_path):
    lines = [record(id=str(i), timestamp=f"2024-01-01T00:{i:02d}:00Z") for i in range(40)]
    K.write_consolidated(
        R.accepted(R.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))), str(tmp_path / "c"))
    arrived = R.read_alert_parquet(spark, str(tmp_path / "c"))
    assert arrived.select("event_id").distinct().count() == 40
    alerts = clean.clean_alerts(arrived, keep=("event_id", "arrival_us"))
    metas = A.run_meta_alerts(alerts, gap_minutes=5, cap_minutes=25, k=5, lateness_sec=60).orderBy("start_us").collect()
    assert [(m.alert_count, m.parent_meta_id is not None) for m in metas] == [(26, False), (14, True)]


def test_json_lines_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert K.as_json_lines(df).first().value == '{"a":1,"b":null}'


def test_message_sink_keeps_one_record_per_line(spark, tmp_path):
    df = spark.createDataFrame([("m", "one\ntwo")], "meta_id string, message string")
    K.write_messages(df, str(tmp_path / "t"))
    assert [json.loads(r.value)["message"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["one\ntwo"]


def test_feed_filters_reach_the_scan(spark, tmp_path):
    frame(spark, stream(1, 50)).write.parquet(str(tmp_path / "f"))
    plan = R.filter_feed(spark.read.parquet(str(tmp_path / "f")), ["sads"], 3)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "agent_name" in pushed and "rule_level" in pushed


def write_stream(spark, tmp_path, rows, files=4):
    """Alerts as files in time order, and one far later alert that closes everything before it."""
    df = frame(spark, rows, 1)
    step = len(rows) // files + 1
    for i in range(files):
        part = df.where((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df


def sorted_rows(seed):
    rows = [(e, us, us, agent, group) for e, us, _, agent, group in stream(seed, 500)]
    return [*rows, (len(rows), rows[-1][1] + 10_000 * MIN, 10**12, "zzz", "end")]


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = sorted_rows(21)
    df = write_stream(spark, tmp_path, rows)
    feed = ST.watermarked(R.alert_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1), 60)
    pick = ["agent_id", "rule_groups", "start_us", "end_us", "alert_count", "max_severity", "mitre_hit_count"]
    got = {tuple(r) for r in ST.drain(ST.session_stream(feed, 2), "t").select(*pick).collect()}
    want = {tuple(r) for r in A.fold_in_order(df, 2 * MIN).where("rule_groups <> 'end'").select(*pick).collect()}
    assert got == want


def test_streamed_capped_sessions_equal_batch(spark, tmp_path):
    rows = sorted_rows(22)
    df = write_stream(spark, tmp_path, rows)
    feed = ST.watermarked(R.alert_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1), 60)
    got = ST.drain(ST.capped_session_stream(feed, 2, 5), "t").collect()
    batch = A.run_meta_alerts(df, 2, 5, k=1).where("rule_groups <> 'end'").collect()
    want = {(r.agent_id, r.rule_groups, r.start_us, r.end_us, r.alert_count, r.max_severity) for r in batch}
    assert {(r.agent_id, r.rule_groups, r.start_us, r.end_us, r.alert_count, r.max_severity) for r in got} == want
    assert sum(r.parent_start_us is not None for r in got) == sum(r.parent_meta_id is not None for r in batch) > 0


def test_streamed_windows_and_dedup(spark, tmp_path):
    rows = sorted_rows(23)
    df = write_stream(spark, tmp_path, rows).withColumn("wazuh_alert_id", (F.col("event_id") % 400).cast("string"))
    df.write.parquet(str(tmp_path / "ids"))
    feed = ST.watermarked(R.alert_stream(spark, str(tmp_path / "ids"), df.schema), 600_000)
    assert ST.drain(ST.dedup_stream(feed), "d").count() == 400
    near = ST.watermarked(R.alert_stream(spark, str(tmp_path / "ids"), df.schema), 60)
    windows = ST.drain(ST.compound_stream(near, 15), "w")
    assert windows.agg(F.sum("alert_count")).first()[0] == 500


def test_scored_batches_reach_the_sink(spark, tmp_path):
    seen = []
    handler = ST.score_batches(
        5, lambda metas: metas.withColumn("score", F.when(F.col("alert_count") > 20, 1.0).otherwise(0.1)),
        lambda out, batch: seen.extend((batch, r.meta_id) for r in out.collect()))
    df = write_stream(spark, tmp_path, sorted_rows(24), files=1)
    feed = R.alert_stream(spark, str(tmp_path / "in"), df.schema)
    feed.writeStream.foreachBatch(handler).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    assert seen


def test_lateness_labels_per_micro_batch(spark):
    got = {}
    handle = ST.lateness_batches(10, lambda out, _: got.update({r.event_id: r.lateness for r in out.collect()}))
    handle(frame(spark, [(0, 30_000_000, 0, "a", "g"), (1, 15_000_000, 1, "a", "g"), (2, 0, 2, "a", "g")]), 0)
    assert got == {0: "on_time", 1: "late_ok", 2: "late_drop"}


def test_lost_newest_time_is_an_error(spark, tmp_path):
    """A stream may begin with any batch, and a batch may run again; a lost row between two batches is not passed over."""
    got = {}
    handle = ST.lateness_batches(
        10, lambda out, _: got.update({r.event_id: r.lateness for r in out.collect()}), str(tmp_path / "newest"))
    row = lambda k, us: frame(spark, [(k, us, k, "a", "g")])
    for _ in range(2):
        handle(row(0, 30_000_000), 4)
    handle(row(1, 15_000_000), 5)
    assert got == {0: "on_time", 1: "late_ok"}
    with pytest.raises(AnalysisException):  # batch 4 and 5 left theirs, 6 did not
        handle(row(2, 0), 7)


def test_messages_have_four_lines(spark):
    df = spark.createDataFrame(
        [("m", "sads", "web", "CRITICAL", 9, 3, 59, BASE, BASE + MIN, 0.875, 1)],
        "meta_id string, agent_name string, rule_groups string, decision string, max_severity int, alert_count long, "
        "duration_sec long, start_us long, end_us long, anomaly_score double, escalate int")
    assert M.notification_text(df).first().message.split("\n") == [
        "[ESCALATE] sads | web | CRITICAL", "Severity: 9/15  |  3 alerts dalam 1 menit",
        "Mulai: 08:00 WITA  |  Selesai: 08:01 WITA", "Score anomali: 0.88"]


def test_month_folders(spark, tmp_path):
    for month in ("01", "02"):
        folder = tmp_path / "2024" / month / "hasil_json" / "deep"
        folder.mkdir(parents=True)
        (folder / "x.json").write_text(record() + "\n")
    got = R.scan_month_dirs(spark, str(tmp_path))
    assert {(r.year, r.month, r.reject_reason) for r in got.collect()} == {("2024", "01", None), ("2024", "02", None)}


def test_profile_skew_matches_pandas(spark):
    df = frame(spark, stream(5, 300)).withColumn("has_critical_mitre", F.lit(0))
    got = {r.column_name: r for r in D.moments(df).collect()}
    pdf = df.select("rule_level").toPandas().rule_level
    assert abs(got["rule_level"].skew - pdf.skew()) < 1e-3 and abs(got["rule_level"].std - pdf.std()) < 1e-3
