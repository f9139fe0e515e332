"""Every operator as a named query over the given tables, with its independent SQL check where one exists.

A query is ``add(name, columns, build, sql)``: ``columns`` declares the result columns and their SQL types, which both
sides are cast to; ``build`` takes a :class:`Tables`; ``sql`` is the body of the check (``None``: rows only).
"""

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertfold import schema as S
from alertfold.functions import scalar as X
from alertfold.operators import (
    adaptive, clean, decide as M, evaluate as E, features as FT, forest, ordering as O, perturb as P, profile as D,
    relational as I, sessions as A, windows as W,
)
from alertfold.plans import fixtures, sql as Q
from alertfold.session import ensure_checkpoint_dir, pin_session
from alertfold.sources import alerts as R, sinks as K
from alertfold.streaming import streams as ST

GAP_5, GAP_15, CAP_60 = 5 * S.MINUTE_US, 15 * S.MINUTE_US, 60 * S.MINUTE_US
TYPES = {"s": "VARCHAR", "l": "BIGINT", "i": "INTEGER", "d": "DOUBLE", "b": "BOOLEAN"}
SPARK_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


@dataclass(frozen=True)
class Tables:
    """The views a query reads."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def alerts(self) -> DataFrame:
        return fixtures.alerts(self.spark, self.sf_dir)

    @cached_property
    def day_alerts(self) -> DataFrame:
        return fixtures.day_alerts(self.spark, self.sf_dir)

    @cached_property
    def dups(self) -> DataFrame:
        return fixtures.dup_alerts(self.spark, self.sf_dir)

    @cached_property
    def dirty(self) -> DataFrame:
        return fixtures.dirty_alerts(self.spark, self.sf_dir)

    @cached_property
    def parsed(self) -> DataFrame:
        return R.parse_lines(fixtures.raw_lines(self.spark, self.sf_dir))

    @cached_property
    def released(self) -> DataFrame:
        return O.with_processing_order(self.alerts.select("event_id", "arrival_us", "timestamp"), 50)

    @cached_property
    def kept(self) -> DataFrame:
        return A.ordered_alerts(self.alerts, 50, 60)

    @cached_property
    def adapted(self) -> DataFrame:
        return adaptive.with_adaptive_gap(O.drop_late(O.with_lateness(self.released, 60)), 15)

    @cached_property
    def metas(self) -> DataFrame:
        return A.fold_in_order(self.alerts, GAP_5)

    @cached_property
    def metas_day(self) -> DataFrame:
        return A.fold_in_order(self.day_alerts, GAP_15)

    @cached_property
    def capped(self) -> DataFrame:
        return A.assign_buckets(self.kept, GAP_15, CAP_60)

    @cached_property
    def feats(self) -> DataFrame:
        return FT.enrich(self.metas)

    @cached_property
    def scaled(self) -> DataFrame:
        """Scaled features, kept because fitting and scoring read them several times."""
        kept = self.feats.select("meta_id", *S.FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
        return M.robust_scale(kept).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def raw_scored(self) -> DataFrame:
        points = (F.col("alert_count") * 37 + F.col("max_severity") * 101) % 1000
        return self.feats.withColumn("score", points / F.lit(1000.0))

    @cached_property
    def scored(self) -> DataFrame:
        return M.decide(self.raw_scored, M.threshold(self.raw_scored, override=0.4))

    @cached_property
    def fixed(self) -> DataFrame:
        return W.fixed_windows(self.alerts, 15)

    @cached_property
    def per_group(self) -> DataFrame:
        return E.reduction_per_group(self.alerts, self.metas, self.fixed)

    def stream(self) -> DataFrame:
        """``events`` as a file stream, shaped like :meth:`alerts`."""
        return fixtures.alerts_from(
            self.spark.readStream.schema(fixtures.table(self.spark, self.sf_dir, "events").schema)
            .option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 100).parquet(self.sf_dir))

    def folder(self, name: str) -> str:
        """A new folder below the shared checkpoint folder."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Query:
    columns: dict[str, str]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.build(Tables(pin_session(spark), sf_dir))
        return out.select(*[F.col(c).cast(SPARK_TYPES[t]).alias(c) for c, t in self.columns.items()])

    def oracle(self) -> str | None:
        return None if self.sql is None else Q.query(self.sql, self.columns)


CATALOG: dict[str, Query] = {}


def add(name: str, columns: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    spec = {c.split(":")[0]: TYPES[c.split(":")[1]] for c in columns.split()}
    CATALOG[name] = Query(spec, build, sql)


us = lambda c: F.unix_micros(c)

# ---- sources --------------------------------------------------------------------------------------

BAD = "event_id % 101"
PRIMARY = """CASE WHEN event_id % 3 = 0 AND rule_groups = 'sudo' THEN 'ossec' ELSE rule_groups END"""
SENDER = f"CASE WHEN {BAD} <> 9 THEN nullif(srcip, '') END"
KIND = f"CASE WHEN {BAD} = 9 THEN 'none' ELSE srcip_type END"
add("S1_read_alert_json",
    "event_id:l wazuh_alert_id:s ts_us:l agent_id:s agent_name:s rule_group_primary:s rule_level:i rule_id:s srcip:s "
    "srcip_type:s criticality_score:i has_mitre:i has_critical_mitre:i",
    lambda t: R.accepted(t.parsed, S.MINIMAL_COLUMNS, ("event_id",)).withColumn("ts_us", us("timestamp_utc")),
    f"""SELECT * REPLACE (lpad(CAST(event_id % 8 + 1 AS VARCHAR), 3, '0') AS agent_id, {SENDER} AS srcip, {KIND} AS srcip_type),
      {PRIMARY} AS rule_group_primary FROM alerts WHERE {BAD} > 5""")
add("S2_reject_reasons", "reason:s n:l", lambda t: R.reject_counts(t.parsed),
    f"""SELECT CASE {BAD} WHEN 0 THEN 'blank' WHEN 1 THEN 'json_error' WHEN 2 THEN 'empty_timestamp'
      WHEN 3 THEN 'bad_timestamp' WHEN 4 THEN 'no_rule_id' WHEN 5 THEN 'no_rule_groups' ELSE 'accepted' END AS reason,
      count(*) AS n FROM alerts GROUP BY ALL""")


def _month_dirs(t: Tables) -> DataFrame:
    root = t.folder("month-dirs")
    lines = fixtures.raw_lines(t.spark, t.sf_dir).select("value", (F.col("event_id") % 2 + 1).cast("string").alias("m"))
    for month in ("1", "2"):
        lines.where(F.col("m") == month).select("value").write.text(f"{root}/2024/{month}/hasil_json")
    found = R.scan_month_dirs(t.spark, root, "*.txt")
    return R.reject_counts(found.withColumn(
        "reject_reason", F.concat_ws("/", "year", "month", F.coalesce("reject_reason", F.lit("accepted")))))


add("S3_scan_month_dirs", "reason:s n:l", _month_dirs,
    f"""SELECT '2024/' || (event_id % 2 + 1) || '/' || CASE {BAD} WHEN 0 THEN 'blank' WHEN 1 THEN 'json_error'
      WHEN 2 THEN 'empty_timestamp' WHEN 3 THEN 'bad_timestamp' WHEN 4 THEN 'no_rule_id' WHEN 5 THEN 'no_rule_groups'
      ELSE 'accepted' END AS reason, count(*) AS n FROM alerts GROUP BY ALL""")


def _csv_roundtrip(t: Tables) -> DataFrame:
    path = t.folder("alert-csv")
    stored = R.accepted(t.parsed, S.FULL_COLUMNS)
    stored = stored.withColumn("timestamp_utc", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    stored.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
    return R.read_alert_csv(t.spark, path, multi_line=False)  # no stored field holds a line break here


STORED = f"""(SELECT event_id, wazuh_alert_id, ts_us, lpad(CAST(event_id % 8 + 1 AS VARCHAR), 3, '0') AS agent_id, agent_name,
  {PRIMARY} AS rule_group_primary, rule_level, rule_id, {SENDER} AS srcip, {KIND} AS srcip_type, criticality_score,
  has_mitre, has_critical_mitre, CASE criticality_score WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END
    AS agent_criticality, mitre_tactic, '' AS mitre_technique, 'T1059' AS mitre_id, '' AS syscheck_event, '' AS syscheck_path,
  '' AS syscheck_mode, 'rule ' || rule_id AS rule_description,
  CASE WHEN event_id % 3 = 0 THEN '["ossec","' || rule_groups || '"]' ELSE '["' || rule_groups || '","local"]' END
    AS rule_groups_all, CASE WHEN {BAD} = 8 THEN 1 ELSE event_id % 5 + 1 END AS rule_firedtimes, '10.1.1.1' AS agent_ip, 'sshd' AS decoder_name,
  '/var/log/' || rule_groups AS location, CASE WHEN {BAD} = 9 THEN '' ELSE '/index' END AS data_url, '' AS audit_command, 'mgr' AS manager_name,
  repeat('x', CAST(event_id % 400 AS INTEGER)) || wazuh_alert_id AS full_log FROM alerts WHERE {BAD} > 5)"""
add("S4_read_alert_csv", " ".join(f"{c}:s" for c in S.FULL_COLUMNS), _csv_roundtrip,
    "SELECT " + ", ".join(
        "strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.%f') AS timestamp_utc" if c == "timestamp_utc"
        else f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in S.FULL_COLUMNS) + f" FROM {STORED}")


def _meta_csv(t: Tables) -> DataFrame:
    path = t.folder("meta-csv")
    K.write_meta_csv(t.metas.select("meta_id", X.iso_utc(F.col("start_us")).alias("start_time"),
                                    X.iso_utc(F.col("end_us")).alias("end_time"), "alert_count"), path)
    back = R.read_meta_csv(t.spark, path, {
        "meta_id": "string", "start_time": "string", "end_time": "string", "alert_count": "bigint"})
    return back.select("meta_id", (us("start_time") / 1_000_000).alias("start_s"),
                       (us("end_time") / 1_000_000).alias("end_s"), "alert_count")


add("S5_read_meta_csv", "meta_id:s start_s:l end_s:l alert_count:l", _meta_csv,
    "SELECT meta_id, start_us // 1000000 AS start_s, end_us // 1000000 AS end_s, alert_count FROM metas")
add("S6_stream_source", "event_id:l agent_name:s rule_level:i",
    lambda t: ST.drain(R.filter_feed(t.stream(), ["sads", "dfir-iris"], 3), "feed"),
    "SELECT event_id, agent_name, rule_level FROM alerts WHERE agent_name IN ('sads', 'dfir-iris') AND rule_level >= 3")


def _jsonl(t: Tables) -> DataFrame:
    path = t.folder("jsonl")
    out = t.alerts.withColumn("srcip", F.when(F.col("srcip") != "", F.col("srcip")))
    K.write_json_lines(out, path)
    back = R.read_jsonl(t.spark, path, out.schema)
    return back.withColumn("ts_us", us("timestamp"))


EVERY = ("event_id:l ts_us:l arrival_us:l wazuh_alert_id:s agent_id:s agent_name:s rule_groups:s rule_level:i rule_id:i srcip:s "
         "mitre_tactic:s is_synthetic:i scenario_id:s srcip_type:s has_mitre:i has_critical_mitre:i criticality_score:i")
add("S7_read_jsonl", EVERY, _jsonl, "SELECT * REPLACE (nullif(srcip, '') AS srcip) FROM alerts")

# ---- sinks ----------------------------------------------------------------------------------------


def _monthly(t: Tables) -> DataFrame:
    path, minimal = t.folder("monthly"), t.folder("monthly-minimal")
    K.write_monthly(R.accepted(t.parsed), path, minimal_path=minimal)
    count = lambda p, layer: t.spark.read.parquet(p).groupBy("year", "month").agg(
        F.count("*").alias("n"), F.count_distinct("wazuh_alert_id").alias("n_ids"),
        F.sum(F.crc32(F.concat_ws("|", *S.MINIMAL_COLUMNS))).alias("checksum")).withColumn("layer", F.lit(layer))
    full, small = count(path, "both"), count(minimal, "both")
    return full.intersect(small)  # the minimal layer holds the same rows


add("K1_monthly_sink", "year:i month:i n:l n_ids:l", _monthly,
    f"""SELECT year(make_timestamp(ts_us)) AS year, month(make_timestamp(ts_us)) AS month, count(*) AS n,
      count(DISTINCT wazuh_alert_id) AS n_ids FROM alerts WHERE {BAD} > 5 GROUP BY ALL""")


def _consolidated(t: Tables) -> DataFrame:
    """Copies arrive later, with another rule and an earlier time; the first arrival stays."""
    path = t.folder("consolidated")
    copy = F.col("arrival_us") >= 600_000_000 + F.expr("unix_micros(timestamp)") - fixtures.BASE_US
    stored = t.dups.withColumns({
        "rule_id": F.when(copy, -1).otherwise(F.col("rule_id")),
        "timestamp_utc": F.when(copy, F.col("timestamp") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("timestamp")),
    }).withColumnRenamed("rule_groups", "rule_group_primary")
    K.write_consolidated(stored.select(*S.MINIMAL_COLUMNS, *K.ARRIVAL), path)
    return R.read_alert_parquet(t.spark, path).withColumn("ts_us", us("timestamp_utc"))


add("K2_consolidated_sink", "wazuh_alert_id:s ts_us:l agent_id:s rule_group_primary:s rule_level:i rule_id:i srcip:s arrival_us:l event_id:l",
    _consolidated, "SELECT *, rule_groups AS rule_group_primary FROM alerts")
ALERT_FIELDS = [c.split(":")[0].replace("ts_us", "timestamp") for c in EVERY.split()]
add("K3_jsonl_export", "value:s", lambda t: K.as_json_lines(t.alerts.select(*ALERT_FIELDS)),
    "SELECT '{' || " + " || ',' || ".join(
        f"""'"{c}":"' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || '"'""" if c == "timestamp"
        else f"""'"{c}":"' || {c} || '"'""" if f"{c}:s" in EVERY.split() else f"""'"{c}":' || {c}"""
        for c in ALERT_FIELDS) + " || '}' AS value FROM alerts")


def _payload(t: Tables) -> DataFrame:
    get = lambda f: F.get_json_object("payload", f"$.{f}")
    return M.soar_payload(t.scored).select(
        get("event_id").alias("event_id"), get("anomaly_score").alias("anomaly_score"), get("severity").alias("severity"),
        get("agent").alias("agent"), get("alert_count").alias("alert_count"), get("mitre_hits").alias("mitre_hits"),
        get("rule_entropy").alias("rule_entropy"), get("baseline_deviation").alias("baseline_deviation"),
        get("decision").alias("decision"), get("reason").alias("reason"))


add("K4_soar_payload",
    "event_id:s anomaly_score:d severity:s agent:s alert_count:l mitre_hits:l rule_entropy:d baseline_deviation:d "
    "decision:s reason:s", _payload,
    """SELECT meta_id AS event_id, anomaly_score, decision AS severity, agent_name AS agent, alert_count,
      mitre_hit_count AS mitre_hits, 0.0 AS rule_entropy, deviation_from_baseline AS baseline_deviation,
      action AS decision, printf('score=%.4f sev=%d mitre=%d entropy=0.000 dev=%.3f', anomaly_score, max_severity,
        CAST(mitre_hit_count AS BIGINT), round(CAST(deviation_from_baseline AS DECIMAL(18, 4)), 3)::DOUBLE) AS reason
      FROM scored WHERE escalate = 1""")
add("K5_notification_text", "meta_id:s message:s", lambda t: M.notification_text(t.scored),
    """SELECT meta_id, CASE WHEN decision IN ('CRITICAL', 'SUSPICIOUS') THEN '[ESCALATE]' ELSE '[DIGEST]' END || ' '
      || agent_name || ' | ' || rule_groups || ' | ' || decision || chr(10) || 'Severity: ' || max_severity || '/15  |  '
      || alert_count || ' alerts dalam ' || greatest(1, duration_sec // 60) || ' menit' || chr(10) || 'Mulai: '
      || strftime(make_timestamp(start_us) + INTERVAL 8 HOUR, '%H:%M') || ' WITA  |  Selesai: '
      || strftime(make_timestamp(end_us) + INTERVAL 8 HOUR, '%H:%M') || ' WITA' || chr(10) || 'Score anomali: '
      || printf('%.2f', round(anomaly_score, 2)) AS message FROM scored WHERE escalate = 1""")
add("K6_scored_export",
    "meta_id:s agent_id:s start_us:l end_us:l alert_count:l alert_count_log:d alert_velocity:d rule_concentration:d "
    "severity_spread:d deviation_from_baseline:d anomaly_score:d decision:s action:s escalate:i",
    lambda t: t.scored.select(*M.scored_columns(t.scored)), "SELECT * FROM scored")
add("K7_anomaly_export", "meta_id:s rule_group:s severity:i alert_count:l anomaly_score:d decision:s action:s",
    lambda t: M.top_anomalies(t.scored, 100),
    """SELECT *, rule_groups AS rule_group, max_severity AS severity FROM scored WHERE escalate = 1
      ORDER BY anomaly_score DESC, meta_id LIMIT 100""")
add("K7_top_per_window", "window_key:l rank:i meta_id:s anomaly_score:d decision:s",
    lambda t: M.top_per_window(t.scored, F.col("hour_of_day")),
    """SELECT hour_of_day AS window_key, * FROM (SELECT *, row_number() OVER (PARTITION BY hour_of_day
      ORDER BY anomaly_score DESC, meta_id) AS rank FROM scored WHERE escalate = 1) WHERE rank <= 10""")


def _summary_csv(t: Tables) -> DataFrame:
    path = t.folder("summary")
    K.write_summary(t.per_group, path)
    return t.spark.read.option("header", True).csv(path)


def _as_csv(t: Tables, name: str, rows: DataFrame) -> DataFrame:
    path = t.folder(name)
    K.write_summary(rows, path)
    return t.spark.read.option("header", True).csv(path)


add("K8_summary_csvs", "rule_group:s n_raw:l arr_session_pct:d", _summary_csv, "SELECT * FROM per_group")
add("K8_sensitivity_csv", "delta_t_min:i n_raw:l n_meta:l arr_pct:d",
    lambda t: _as_csv(t, "sensitivity", E.sensitivity_sweep(t.alerts)), "SELECT * FROM sweep")
add("K8_agent_csv", "agent_name:s n:l max_level:i n_rule_groups:l", lambda t: _as_csv(t, "agents", D.agent_profile(t.alerts)),
    """SELECT agent_name, count(*) AS n, max(rule_level) AS max_level, count(DISTINCT rule_groups) AS n_rule_groups
      FROM alerts GROUP BY agent_name""")

# ---- projections and cleaning ---------------------------------------------------------------------

add("P1_primary_group", "event_id:l rule_group_primary:s",
    lambda t: R.accepted(t.parsed, ["rule_group_primary"], ("event_id",)),
    f"SELECT event_id, {PRIMARY} AS rule_group_primary FROM alerts WHERE {BAD} > 5")
add("P2_classify_srcip", "event_id:l srcip_type:s",
    lambda t: t.alerts.select("event_id", X.srcip_type(F.col("srcip")).alias("srcip_type")),
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 3 THEN 'external' ELSE 'internal' END AS srcip_type
      FROM alerts""")
add("P3_criticality_lookup", "event_id:l label:s score:i",
    lambda t: t.alerts.withColumn("label", X.criticality_label(F.col("agent_name"))).withColumn(
        "score", X.criticality_of_label(F.col("label"))),
    """SELECT event_id, CASE criticality_score WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low'
      END AS label, criticality_score AS score FROM alerts""")
add("P4_mitre_flags", "event_id:l has_mitre:i has_critical_mitre:i",
    lambda t: R.accepted(t.parsed, ["has_mitre", "has_critical_mitre"], ("event_id",)),
    f"""SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 1 ELSE 0 END AS has_mitre,
      CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS has_critical_mitre FROM alerts WHERE {BAD} > 5""")
add("P5_pad_agent_id", "event_id:l padded:s",
    lambda t: t.alerts.select("event_id", X.pad_agent_id(F.col("event_id").cast("string")).alias("padded")),
    "SELECT event_id, CASE WHEN event_id < 1000 THEN printf('%03d', event_id) ELSE CAST(event_id AS VARCHAR) END AS padded FROM alerts")
add("P6_enrichment_columns",
    "event_id:l agent_criticality:s mitre_tactic:s mitre_technique:s mitre_id:s syscheck_event:s syscheck_path:s "
    "syscheck_mode:s rule_description:s "
    "rule_groups_all:s rule_firedtimes:i agent_ip:s decoder_name:s location:s data_url:s audit_command:s manager_name:s "
    "full_log:s",
    lambda t: R.accepted(t.parsed, S.FULL_COLUMNS, ("event_id",)),
    f"SELECT * FROM {STORED}")

# The dirty fixture's columns, restated for the checks.
D_ID = "CASE event_id % 53 WHEN 0 THEN 'md5' WHEN 1 THEN 'host-x' WHEN 2 THEN 'DVWA' ELSE agent_id END"
D_GROUP = "CASE event_id % 43 WHEN 0 THEN NULL WHEN 1 THEN '  ' || upper(rule_groups) || ' ' ELSE rule_groups END"
D_LEVEL = "CASE event_id % 41 WHEN 0 THEN '99' WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE CAST(rule_level AS VARCHAR) END"
D_IP = "CASE event_id % 37 WHEN 0 THEN 'nan' WHEN 1 THEN NULL ELSE srcip END"
KEPT_ID, KEPT_TS = "event_id % 53 NOT IN (0, 1)", "event_id % 61 NOT IN (0, 1)"
C_LEVEL = "CASE WHEN event_id % 41 IN (0, 1, 2) THEN 0 ELSE rule_level END"
C_SCORE = "CASE event_id % 23 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE criticality_score END"
add("P7_select_rename", "event_id:l agent_id:s rule_groups:s rule_level:s srcip:s",
    lambda t: clean.select_rename(t.dirty, ("event_id",)),
    f"SELECT event_id, {D_ID} AS agent_id, {D_GROUP} AS rule_groups, {D_LEVEL} AS rule_level, {D_IP} AS srcip FROM alerts")
add("P8_drop_corrupt", "event_id:l agent_id:s", lambda t: clean.drop_corrupt(t.dirty),
    f"SELECT event_id, {D_ID} AS agent_id FROM alerts WHERE {KEPT_ID}")
add("P9_parse_timestamp", "event_id:l ts_us:l",
    lambda t: clean.drop_bad_timestamps(clean.select_rename(t.dirty, ("event_id",))).withColumn("ts_us", us("timestamp")),
    f"SELECT event_id, ts_us FROM alerts WHERE {KEPT_TS}")
add("P9_clean_report", "n_in:l n_corrupt:l n_bad_timestamp:l n_kept:l", lambda t: clean.clean_report(t.dirty),
    f"""SELECT count(*) AS n_in, count(*) FILTER (NOT {KEPT_ID}) AS n_corrupt,
      count(*) FILTER ({KEPT_ID} AND NOT {KEPT_TS}) AS n_bad_timestamp, count(*) FILTER ({KEPT_ID} AND {KEPT_TS}) AS n_kept
      FROM alerts""".replace("NOT event_id % 53 NOT IN", "event_id % 53 IN").replace(
        "NOT event_id % 61 NOT IN", "event_id % 61 IN"))
add("P10_rule_level_clean", "event_id:l rule_level:i",
    lambda t: clean.clean_level(clean.select_rename(t.dirty, ("event_id",))),
    f"SELECT event_id, {C_LEVEL} AS rule_level FROM alerts")
add("P11_identity_defaults", "event_id:l srcip:s srcip_type:s agent_id:s rule_id:i",
    lambda t: clean.clean_identity(clean.select_rename(t.dirty, ("event_id",))),
    f"""SELECT event_id, CASE WHEN event_id % 37 IN (0, 1) THEN '' ELSE srcip END AS srcip,
      CASE WHEN event_id % 31 = 0 THEN 'none' ELSE srcip_type END AS srcip_type, {D_ID} AS agent_id,
      CASE WHEN event_id % 29 = 0 THEN 0 ELSE rule_id END AS rule_id FROM alerts""")
add("P12_criticality_clean", "event_id:l criticality_score:i",
    lambda t: clean.clean_criticality(clean.select_rename(t.dirty, ("event_id",))),
    f"SELECT event_id, {C_SCORE} AS criticality_score FROM alerts")
add("P13_mitre_flag_clean", "event_id:l has_mitre:i has_critical_mitre:i",
    lambda t: clean.clean_mitre_flags(clean.select_rename(t.dirty, ("event_id",))),
    """SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 1 ELSE has_mitre END AS has_mitre,
      CASE WHEN event_id % 19 = 1 THEN 0 ELSE has_critical_mitre END AS has_critical_mitre FROM alerts""")
add("P14_rule_groups_clean", "event_id:l rule_groups:s",
    lambda t: clean.clean_groups(clean.select_rename(t.dirty, ("event_id",))),
    "SELECT event_id, CASE WHEN event_id % 43 = 0 THEN 'unknown' ELSE rule_groups END AS rule_groups FROM alerts")
add("P14_clean_alerts", "event_id:l ts_us:l agent_id:s rule_groups:s rule_level:i criticality_score:i is_synthetic:i",
    lambda t: clean.clean_alerts(t.dirty, ("event_id",)).withColumn("ts_us", us("timestamp")),
    f"""SELECT event_id, ts_us, {D_ID} AS agent_id, CASE WHEN event_id % 43 = 0 THEN 'unknown' ELSE rule_groups END AS
      rule_groups, {C_LEVEL} AS rule_level, {C_SCORE} AS criticality_score, is_synthetic
      FROM alerts WHERE {KEPT_ID} AND {KEPT_TS}""")
add("P15_severity_bucket", "bucket:s n:l",
    lambda t: t.alerts.groupBy(X.severity_bucket(F.col("rule_level")).alias("bucket")).agg(F.count("*").alias("n")),
    """SELECT CASE WHEN rule_level <= 2 THEN '1-2_Info' WHEN rule_level <= 4 THEN '3-4_Medium' WHEN rule_level <= 6
      THEN '5-6_High' ELSE '7+_Critical' END AS bucket, count(*) AS n FROM alerts GROUP BY ALL""")
add("P16_severity_zone", "zone:s n:l pct:d", lambda t: D.zone_share(t.alerts),
    """SELECT CASE WHEN rule_level <= 4 THEN 'Low' WHEN rule_level <= 6 THEN 'Medium' WHEN rule_level <= 11 THEN 'High'
      ELSE 'Critical' END AS zone, count(*) AS n, round(count(*) / (SELECT count(*) FROM alerts)::DOUBLE * 100, 4) AS pct
      FROM alerts GROUP BY ALL""")
add("P17_group_severity_code", "event_id:l enc:i uses_default:i",
    lambda t: t.dirty.select("event_id", X.group_severity_code(F.col("rule_group_primary")).alias("enc"), F.when(
        X.group_is_mapped(F.col("rule_group_primary")), 0).otherwise(1).alias("uses_default")),
    f"""SELECT event_id, CASE g WHEN 'syslog' THEN 1 WHEN 'sudo' THEN 2 WHEN 'syscheck_file' THEN 3 WHEN 'web' THEN 4
      WHEN 'authentication_failed' THEN 4 ELSE 2 END AS enc, CASE WHEN g IS NULL THEN 1 ELSE 0 END AS uses_default
      FROM (SELECT event_id, lower(trim({D_GROUP})) AS g FROM alerts)""")
add("P18_agent_criticality", "event_id:l crit:i",
    lambda t: t.alerts.select("event_id", X.agent_criticality(
        (F.col("event_id") % 3 + 1).cast("int"), F.concat(F.lit(" "), F.upper("agent_name"))).alias("crit")),
    "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 3 + 1 ELSE criticality_score END AS crit FROM alerts")
add("P19_hour_of_day", "event_id:l hour_of_day:i",
    lambda t: t.day_alerts.select("event_id", F.hour("timestamp").alias("hour_of_day")),
    "SELECT event_id, hour(make_timestamp(ts_us)) AS hour_of_day FROM day_alerts")
add("P20_local_calendar", "event_id:l local_date:s local_hour:i day_of_week:i month:s week_start:s",
    lambda t: D.with_calendar(t.day_alerts), "SELECT * FROM local")
add("P21_subnet24", "event_id:l subnet:s",
    lambda t: t.alerts.select("event_id", X.subnet24(F.col("srcip")).alias("subnet")),
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '10.0.0' WHEN 2 THEN '192.168.1'
      ELSE '203.0.113' END AS subnet FROM alerts""")
add("P22_high_severity_capture", "event_id:l rule_level:i", lambda t: ST.high_severity_stream(t.alerts),
    "SELECT event_id, rule_level FROM alerts WHERE rule_level >= 7")
add("P22_high_severity_stream", "event_id:l rule_level:i",
    lambda t: ST.drain(ST.high_severity_stream(t.stream()).select("event_id", "rule_level"), "severe"),
    "SELECT event_id, rule_level FROM alerts WHERE rule_level >= 7")
add("P23_feature_type_guard", "event_id:l rule_level:d alert_velocity:d",
    lambda t: FT.guard_types(t.dirty, ["rule_level", "alert_velocity"]),
    f"SELECT event_id, coalesce(TRY_CAST({D_LEVEL} AS DOUBLE), 0) AS rule_level, 0.0 AS alert_velocity FROM alerts")

# ---- relational -----------------------------------------------------------------------------------

add("I1_dedup_alerts", "wazuh_alert_id:s arrival_us:l event_id:l", lambda t: I.dedup_alerts(t.dups),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wazuh_alert_id ORDER BY arrival_us, event_id) AS r
      FROM dup_alerts) WHERE r = 1""")
add("I2_merge_months", "event_id:l ts_us:l",
    lambda t: I.merge_batches([t.alerts, t.dups]).withColumn("ts_us", us("timestamp")),
    "SELECT DISTINCT event_id, ts_us FROM dup_alerts")
add("I3_union_injected", "wazuh_alert_id:s ts_us:l arrival_us:l is_synthetic:i scenario_id:s",
    lambda t: I.union_injected(t.alerts, P.template_rows(t.alerts, "B")).withColumn("ts_us", us("timestamp")),
    """SELECT wazuh_alert_id, ts_us, arrival_us, is_synthetic, scenario_id FROM alerts UNION ALL
      SELECT 'SYN-B-' || p || '-' || i, (lo_us + (hi_us - lo_us) * 50 // 100) // 1000000 * 1000000 + p * 300000000
        + i * step * 1000000, NULL, 1, 'B'
      FROM span, (SELECT 0 AS p, 4 AS step, unnest(range(0, 2000)) AS i UNION ALL SELECT 1, 6, unnest(range(0, 1500))
        UNION ALL SELECT 2, 8, unnest(range(0, 1000)))""")
add("I4_sort_time", "event_id:l ts_us:l", lambda t: I.sort_time(t.alerts).withColumn("ts_us", us("timestamp")),
    "SELECT event_id, ts_us FROM alerts ORDER BY ts_us, event_id")
add("I5_top_agents", "agent_name:s n:l", lambda t: I.top_k(t.alerts, ["agent_name"], 5),
    "SELECT agent_name, count(*) AS n FROM alerts GROUP BY ALL ORDER BY n DESC, agent_name LIMIT 5")
add("I5_top_pairs", "agent_name:s rule_id:i n:l", lambda t: I.top_k(t.alerts, ["agent_name", "rule_id"], 30),
    "SELECT agent_name, rule_id, count(*) AS n FROM alerts GROUP BY ALL ORDER BY n DESC, agent_name, rule_id LIMIT 30")
add("I5_top_share", "value:s n:l pct:d", lambda t: I.top_share(t.alerts, "agent_name", 5),
    """SELECT CASE WHEN r <= 5 THEN agent_name ELSE 'others' END AS value, sum(n) AS n,
      round(sum(n) / (SELECT count(*) FROM alerts)::DOUBLE * 100, 4) AS pct
      FROM (SELECT *, row_number() OVER (ORDER BY n DESC, agent_name) AS r FROM (
        SELECT agent_name, count(*) AS n FROM alerts GROUP BY ALL)) GROUP BY ALL""")
add("I6_label_join", "meta_id:s ground_truth:i",
    lambda t: I.label_join(t.metas, t.metas.where(F.col("alert_count") > 2).select(
        "meta_id", F.col("ground_truth"))),
    "SELECT meta_id, CASE WHEN alert_count > 2 THEN ground_truth ELSE 0 END AS ground_truth FROM metas")
add("I7_set_difference", "event_id:l side:s",
    lambda t: I.set_difference(t.alerts.where(F.col("rule_level") > 1), t.alerts.where(F.col("has_mitre") == 1), ["event_id"]),
    """SELECT event_id, 'left' AS side FROM alerts WHERE rule_level > 1 AND has_mitre = 0 UNION ALL
      SELECT event_id, 'right' FROM alerts WHERE rule_level <= 1 AND has_mitre = 1""")
add("I8_missing_dates", "local_date:s",
    lambda t: I.missing_dates(D.with_calendar(t.day_alerts).where(F.col("rule_level") == 15)),
    """SELECT CAST(d AS DATE) AS local_date FROM (SELECT unnest(generate_series(min(local_date), max(local_date),
      INTERVAL 1 DAY)) AS d FROM local WHERE rule_level = 15) WHERE CAST(d AS DATE) NOT IN (
      SELECT local_date FROM local WHERE rule_level = 15)""")
DRAW = f"((event_id + 42) * 48271 % {Q.P} * ((event_id + 42) * 48271 % {Q.P}) % {Q.P})"
add("I9_seeded_sample", "event_id:l ts_us:l",
    lambda t: I.sort_time(I.seeded_sample(t.alerts, 500, 42, draw=F.expr(f"{DRAW} * 4294967296"))).withColumn(
        "ts_us", us("timestamp")),
    f"SELECT event_id, ts_us FROM alerts ORDER BY {DRAW}, event_id LIMIT 500")

# ---- order, lateness, adaptive gap ----------------------------------------------------------------

add("T1_bounded_reorder", "event_id:l seq:l eff_us:l eff_event:l overtaken:i",
    lambda t: t.released.withColumn("eff_event", F.col("eff_tie")),
    """SELECT o.event_id, o.seq, o.eff_us, e.event_id AS eff_event, o.late AS overtaken FROM ordered o
      JOIN ordered e ON e.seq = o.eff_seq""")
add("T2_lateness_class", "event_id:l lateness:s", lambda t: O.with_lateness(t.released, 60),
    "SELECT event_id, lateness FROM classified")
add("T3_drop_late", "event_id:l", lambda t: O.drop_late(O.with_lateness(t.released, 60)), "SELECT event_id FROM kept")
add("T4_lateness_counts", "lateness:s n:l pct:d", lambda t: O.lateness_counts(O.with_lateness(t.released, 60)),
    """SELECT lateness, count(*) AS n, round(count(*) / (SELECT count(*) FROM alerts)::DOUBLE * 100, 4) AS pct
      FROM classified GROUP BY ALL""")
add("T5_adaptive_gap", "event_id:l cur_dt_us:l", lambda t: t.adapted, "SELECT event_id, cur_dt_us FROM adapted")
add("T6_gap_history", "eff_us:l seq:l ts_us:l dt_min:d", lambda t: adaptive.gap_history(t.adapted),
    "SELECT eff_us, seq, ts_us, cur_dt_us / 60000000 AS dt_min FROM adapted")
add("T6_adaptive_history", "n:l min_dt_min:d max_dt_min:d final_dt_min:d", lambda t: adaptive.gap_summary(t.adapted),
    f"""SELECT count(*) AS n, round(min(dt), 4) AS min_dt_min, round(max(dt), 4) AS max_dt_min,
      round(arg_max(dt, place), 4) AS final_dt_min FROM (
      SELECT cur_dt_us / 60000000 AS dt, row_number() OVER (ORDER BY {Q.RELEASE}) AS place FROM adapted)""")

# ---- sessions and windows -------------------------------------------------------------------------

META = (
    "meta_id:s parent_meta_id:s agent_id:s rule_groups:s agent_name:s start_us:l end_us:l duration_sec:l alert_count:l "
    "max_severity:i severity_sum:l attacker_count:l rule_group_severity_enc:i agent_criticality:i hour_of_day:i "
    "unique_rules_triggered:l mitre_hit_count:l external_threat_count:l internal_src_count:l attacker_ips:s "
    "top_rule_count:l severity_dist:s rule_id_dist:s rule_group_dist:s ground_truth:i scenario_id:s"
)
add("A1_meta_sessions", META, lambda t: A.meta_alerts(A.assign_buckets(t.kept, GAP_5)), "SELECT * FROM metas_t1")
add("A2_capped_sessions", META, lambda t: A.meta_alerts(t.capped), "SELECT * FROM metas_cap")
add("A1_adaptive_sessions", META, lambda t: A.run_meta_alerts(t.alerts, 15, 60, 50, 60, adaptive=True),
    "SELECT * FROM metas_adapt")
add("A3_compound_windows",
    "agent_id:s agent_name:s window_start_us:l window_end_us:l start_us:l end_us:l duration_sec:l alert_count:l "
    "max_severity:i mitre_hit_count:l n_rule_groups:l n_tactics:l attacker_count:l attacker_ips:s rule_group_dist:s",
    lambda t: W.compound_windows(t.alerts, 15),
    """SELECT *, wstart AS window_start_us, wstart + 900000000 AS window_end_us,
      (end_us - start_us) // 1000000 AS duration_sec FROM (
      SELECT agent_id, wstart, min(agent_name) AS agent_name, min(ts_us) AS start_us, max(ts_us) AS end_us,
        count(*) AS alert_count, max(rule_level) AS max_severity, sum(has_mitre) AS mitre_hit_count,
        count(DISTINCT rule_groups) AS n_rule_groups,
        sum(CASE WHEN mitre_tactic = '' THEN 0 WHEN mitre_tactic LIKE '%|%' THEN 2 ELSE 1 END) AS n_tactics,
        count(DISTINCT nullif(srcip, '')) AS attacker_count,
        coalesce(array_to_string(list_sort(list(DISTINCT srcip) FILTER (srcip <> '')), '|'), '') AS attacker_ips
      FROM fixed GROUP BY ALL)
      JOIN (SELECT agent_id, wstart, '{' || string_agg('"' || rule_groups || '":' || c, ',' ORDER BY rule_groups) || '}'
        AS rule_group_dist FROM (SELECT agent_id, wstart, rule_groups, count(*) AS c FROM fixed GROUP BY ALL) GROUP BY ALL)
      USING (agent_id, wstart)""")
add("A3_compound_tactics", "agent_id:s window_start_us:l event_id:l tactic_no:i tactic:s",
    lambda t: W.compound_tactics(t.alerts, 15),
    """SELECT agent_id, wstart AS window_start_us, event_id, i - 1 AS tactic_no, string_split(mitre_tactic, '|')[i] AS tactic
      FROM (SELECT *, unnest(range(1, len(string_split(mitre_tactic, '|')) + 1)) AS i FROM fixed WHERE mitre_tactic <> '')""")
add("A3_compound_attackers", "agent_id:s window_start_us:l srcip:s alert_count:l",
    lambda t: W.compound_attackers(t.alerts, 15),
    """SELECT agent_id, wstart AS window_start_us, srcip, count(*) AS alert_count FROM fixed WHERE srcip <> ''
      GROUP BY ALL""")
add("A4_fixed_windows",
    "agent_id:s rule_groups:s window_start_us:l window_end_us:l start_us:l end_us:l duration_sec:l alert_count:l "
    "max_severity:i mitre_hit_count:l external_threat_count:l unique_rules_triggered:l rule_group_severity_enc:i "
    "agent_criticality:i hour_of_day:i attacker_count:l attacker_ips:s severity_dist:s rule_id_dist:s",
    lambda t: t.fixed,
    """SELECT c.*, wstart AS window_start_us, wstart + 900000000 AS window_end_us,
      (end_us - start_us) // 1000000 AS duration_sec, r.dist AS rule_id_dist, r.k AS unique_rules_triggered,
      l.dist AS severity_dist, (start_us // 3600000000) % 24 AS hour_of_day, CASE rule_groups WHEN 'syslog' THEN 1
        WHEN 'sudo' THEN 2 WHEN 'syscheck_file' THEN 3 ELSE 4 END AS rule_group_severity_enc
      FROM (SELECT agent_id, rule_groups, wstart, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS alert_count,
        max(rule_level) AS max_severity, sum(has_mitre) AS mitre_hit_count, max(criticality_score) AS agent_criticality,
        count(*) FILTER (srcip_type = 'external') AS external_threat_count,
        count(DISTINCT nullif(srcip, '')) AS attacker_count,
        coalesce(array_to_string(list_sort(list(DISTINCT srcip) FILTER (srcip <> '')), '|'), '') AS attacker_ips
        FROM fixed GROUP BY ALL) c
      JOIN (SELECT agent_id, rule_groups, wstart, count(*) AS k, '{' || string_agg('"' || v || '":' || n, ',' ORDER BY v)
        || '}' AS dist FROM (SELECT agent_id, rule_groups, wstart, CAST(rule_id AS VARCHAR) AS v, count(*) AS n FROM fixed
        GROUP BY ALL) GROUP BY agent_id, rule_groups, wstart) r USING (agent_id, rule_groups, wstart)
      JOIN (SELECT agent_id, rule_groups, wstart, '{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}' AS dist
        FROM (SELECT agent_id, rule_groups, wstart, CAST(rule_level AS VARCHAR) AS v, count(*) AS n FROM fixed
        GROUP BY ALL) GROUP BY agent_id, rule_groups, wstart) l USING (agent_id, rule_groups, wstart)""")
add("A5_value_distributions", "meta_id:s severity_dist:s rule_id_dist:s rule_group_dist:s", lambda t: t.metas,
    "SELECT * FROM metas")
add("A6_tactic_sequence", "agent_id:s rule_groups:s bucket_start_us:l seq:l tactic_no:i tactic:s",
    lambda t: A.tactic_sequence(A.assign_buckets(t.kept, GAP_5)),
    """SELECT agent_id, rule_groups, bstart AS bucket_start_us, seq, i - 1 AS tactic_no,
      string_split(mitre_tactic, '|')[i] AS tactic FROM (
      SELECT *, unnest(range(1, len(string_split(mitre_tactic, '|')) + 1)) AS i FROM m_t1 WHERE mitre_tactic <> '')""")
add("A7_alert_to_bucket", "event_id:l agent_id:s rule_groups:s bucket_start_us:l", lambda t: A.mapping(t.capped),
    "SELECT *, bstart AS bucket_start_us FROM m_cap")
add("A8_validate_mapping",
    "total_mapped:l unique_mapped:l overlap_count:l n_mismatch:l only_in_map:l only_in_metas:l ok:b",
    lambda t: A.validate_mapping(A.mapping(t.capped), A.meta_alerts(t.capped)),
    """SELECT count(*) AS total_mapped, count(DISTINCT event_id) AS unique_mapped, 0 AS overlap_count, 0 AS n_mismatch,
      0 AS only_in_map, 0 AS only_in_metas, true AS ok FROM m_cap""")
add("A9_simple_sessions", META, lambda t: t.metas, "SELECT * FROM metas")
add("A10_rolling_lookback",
    "trigger_seq:l agent_id:s rule_groups:s start_us:l end_us:l alert_count:l max_severity:i top_rule_count:l",
    lambda t: W.rolling_lookback(t.alerts, 500, 600, 5),
    f"""SELECT trigger_seq, agent_id, rule_groups, min(ts_us) AS start_us, max(ts_us) AS end_us, sum(c) AS alert_count,
      max(lv) AS max_severity, max(c) AS top_rule_count FROM (
      SELECT trigger_seq, agent_id, rule_groups, sess, rule_id, min(ts_us) AS t0, max(ts_us) AS ts_us, count(*) AS c,
        max(rule_level) AS lv FROM (
        SELECT *, sum(CASE WHEN p IS NULL OR ts_us - p > 300000000 THEN 1 ELSE 0 END) OVER (
          PARTITION BY trigger_seq, agent_id, rule_groups ORDER BY ts_us, event_id) AS sess FROM (
          SELECT a.*, g.event_id AS trigger_seq, lag(a.ts_us) OVER (
            PARTITION BY g.event_id, a.agent_id, a.rule_groups ORDER BY a.ts_us, a.event_id) AS p
          FROM alerts a JOIN (SELECT event_id, ts_us FROM alerts WHERE (event_id + 1) % 500 = 0) g
            ON a.event_id <= g.event_id AND a.ts_us >= g.ts_us - 600000000)) GROUP BY ALL)
      GROUP BY trigger_seq, agent_id, rule_groups, sess""".replace("min(ts_us) AS start_us", "min(t0) AS start_us"))
add("A11_global_bursts", "start_us:l end_us:l n_alerts:l duration_sec:d agents:l groups:l max_level:i",
    lambda t: W.global_bursts(t.day_alerts), "SELECT * FROM bursts")
add("A11_burst_sizes", "size_bin:s n_bursts:l n_alerts:l", lambda t: W.burst_sizes(W.global_bursts(t.day_alerts)),
    """SELECT CASE WHEN n_alerts <= 1 THEN '1' WHEN n_alerts <= 5 THEN '2-5' WHEN n_alerts <= 10 THEN '6-10'
      WHEN n_alerts <= 50 THEN '11-50' WHEN n_alerts <= 100 THEN '51-100' ELSE '>100' END AS size_bin,
      count(*) AS n_bursts, sum(n_alerts) AS n_alerts FROM bursts GROUP BY 1""".replace(
        "FROM bursts GROUP BY 1", "FROM (SELECT n_alerts FROM bursts) AS b(n_alerts) GROUP BY 1"))
add("A11_top_bursts", "start_us:l n_alerts:l agents:l max_level:i",
    lambda t: W.global_bursts(t.day_alerts).orderBy(F.desc("n_alerts"), "start_us").limit(10),
    "SELECT * FROM bursts ORDER BY n_alerts DESC, start_us LIMIT 10")
COUNTS = """SELECT 'agent' AS dimension, agent_name AS value, count(*) AS n FROM alerts GROUP BY ALL UNION ALL
  SELECT 'rule_group', rule_groups, count(*) FROM alerts GROUP BY ALL UNION ALL
  SELECT 'severity', CASE WHEN rule_level <= 2 THEN '1-2_Info' WHEN rule_level <= 4 THEN '3-4_Medium' WHEN rule_level <= 6
    THEN '5-6_High' ELSE '7+_Critical' END, count(*) FROM alerts GROUP BY ALL UNION ALL
  SELECT 'mitre', CASE WHEN has_mitre = 1 THEN 'yes' ELSE 'no' END, count(*) FROM alerts GROUP BY ALL UNION ALL
  SELECT 'total', 'all', count(*) FROM alerts"""
add("A12_stream_counts", "dimension:s value:s n:l", lambda t: W.stream_counts(t.alerts), COUNTS)
add("A12_running_counts", "dimension:s value:s n:l",
    lambda t: ST.drain(ST.count_stream(t.stream()), "counts", "complete"), COUNTS)
# A streamed session is emitted once the watermark (newest time, in milliseconds, less twice the lateness) passes its end.
CLOSED = "start_us:l end_us:l alert_count:l max_severity:i mitre_hit_count:l"
add("A13_stream_sessions", f"agent_id:s rule_groups:s {CLOSED}",
    lambda t: ST.drain(ST.session_stream(ST.watermarked(t.stream(), 60), 5), "sessions"),
    """SELECT * FROM metas WHERE end_us + 300000000 <= (SELECT max(ts_us) // 1000 * 1000 - 120000000 FROM alerts)""")
add("A13_capped_stream_sessions", f"agent_id:s rule_groups:s parent_start_us:l {CLOSED}",
    lambda t: ST.drain(ST.capped_session_stream(ST.watermarked(t.stream(), 60), 15, 60), "capped"),
    """SELECT * FROM time_buckets WHERE start_us < last_start
      OR (end_us + 900000000) // 1000 + 1 < (SELECT max(ts_us) // 1000 - 120000 FROM alerts)""")

# ---- features -------------------------------------------------------------------------------------

add("F1_alert_count_log", "meta_id:s alert_count_log:d", lambda t: FT.alert_count_log(t.metas), "SELECT * FROM feats")
add("F2_alert_velocity", "meta_id:s alert_velocity:d", lambda t: FT.alert_velocity(t.metas), "SELECT * FROM feats")
add("F3_rule_concentration", "meta_id:s rule_concentration:d from_json:d",
    lambda t: FT.rule_concentration(t.metas).withColumn("from_json", FT.concentration_of(F.col("rule_id_dist"))),
    "SELECT meta_id, rule_concentration, rule_concentration AS from_json FROM feats")
add("F4_severity_spread", "meta_id:s severity_spread:d from_json:d",
    lambda t: FT.severity_spread(t.metas).withColumn("from_json", FT.spread_of(
        F.col("max_severity"), F.col("severity_dist"))),
    "SELECT meta_id, severity_spread, severity_spread AS from_json FROM feats")
add("F5_baseline_deviation", "meta_id:s deviation_from_baseline:d", lambda t: FT.deviation_from_baseline(t.metas_day),
    "SELECT * FROM feats_day")
add("F6_normalize_core", "meta_id:s duration_sec:l rule_group_severity_enc:i agent_criticality:i hour_of_day:i mitre_hit_count:l",
    lambda t: FT.normalize_core(t.metas.drop("rule_group_severity_enc", "hour_of_day")), "SELECT * FROM metas")
FEATURE_COLUMNS = " ".join(f"{f}:d" for f in S.FEATURES)
add("F7_enrich_all", f"meta_id:s {FEATURE_COLUMNS}", lambda t: t.feats, "SELECT * FROM feats")
add("F8_feature_summary", "feature:s min:d max:d n_unique:l q1:d median:d q3:d iqr:d mean:d",
    lambda t: FT.feature_summary(t.feats),
    """SELECT feature, min(value) AS min, max(value) AS max, count(DISTINCT value) AS n_unique,
      round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
      round(quantile_cont(value, 0.75), 6) AS q3,
      round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(avg(value), 4) AS mean
      FROM flong GROUP BY feature""")

# ---- scoring and decisions ------------------------------------------------------------------------

SCALED = ", ".join(
    f"""round((f.{c} - (SELECT median(value) FROM flong WHERE feature = '{c}')) / (SELECT CASE WHEN w = 0 THEN 1 ELSE w END
      FROM (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM flong WHERE feature = '{c}')), 6) AS {c}"""
    for c in S.FEATURES)
add("M1_robust_scale", f"meta_id:s {FEATURE_COLUMNS}",
    lambda t: M.robust_scale(t.feats).withColumns({f: F.round(f, 6) for f in S.FEATURES}),
    f"SELECT meta_id, {SCALED} FROM feats f")


add("M2_isolation_forest_fit", "tree_id:i node_id:i feature:i threshold:d left:i right:i size:i depth:i",
    lambda t: forest.fit(t.scaled)[0])
add("M3_isolation_forest_score", "meta_id:s raw_score:d score:d",
    lambda t: M.normalize_scores(forest.score(t.scaled, *forest.fit(t.scaled))))
# A forest given by hand, so that SQL can walk it: tree, node, feature, cut, left, right, size, depth.
GIVEN_FOREST = [
    (0, 0, 1, 6.0, 1, 2, 64, 0), (0, 1, 0, 1.0, 3, 4, 40, 1), (0, 2, -1, 0.0, -1, -1, 24, 1), (0, 3, -1, 0.0, -1, -1, 38, 2),
    (0, 4, -1, 0.0, -1, -1, 2, 2), (1, 0, 2, 90.0, 1, 2, 64, 0), (1, 1, -1, 0.0, -1, -1, 63, 1), (1, 2, -1, 0.0, -1, -1, 1, 1),
    (2, 0, 5, 11.0, 1, 2, 64, 0), (2, 1, 7, 0.0, 3, 4, 30, 1), (2, 2, -1, 0.0, -1, -1, 34, 1), (2, 3, -1, 0.0, -1, -1, 3, 2),
    (2, 4, 8, 0.5, 5, 6, 27, 2), (2, 5, -1, 0.0, -1, -1, 20, 3), (2, 6, -1, 0.0, -1, -1, 7, 3)]
BONUS = "CASE WHEN %s > 2 THEN 2 * (ln(%s - 1) + 0.5772156649015329) - 2 * (%s - 1) / %s::DOUBLE WHEN %s = 2 THEN 1 ELSE 0 END"
add("M3_given_forest", "meta_id:s raw_score:d",
    lambda t: forest.score(t.feats, t.spark.createDataFrame(GIVEN_FOREST, forest.NODE_SCHEMA), 64).withColumn(
        "raw_score", F.round("raw_score", 6)),
    f"""WITH RECURSIVE given(tree_id, node_id, feature, cut, l, r, size, depth) AS (VALUES {', '.join(map(str, GIVEN_FOREST))}),
      place AS (
        SELECT meta_id, [{', '.join(f'{c}::DOUBLE' for c in S.FEATURES)}] AS x, tree_id, 0 AS node_id
        FROM feats, (SELECT DISTINCT tree_id FROM given)
        UNION ALL
        SELECT meta_id, x, tree_id, CASE WHEN x[feature + 1] <= cut THEN l ELSE r END
        FROM place JOIN given USING (tree_id, node_id) WHERE feature >= 0)
      SELECT meta_id, round(-pow(2, -avg(depth + {BONUS % (('size',) * 5)}) / ({BONUS % (('64',) * 5)})), 6) AS raw_score
      FROM place JOIN given USING (tree_id, node_id) WHERE feature < 0 GROUP BY meta_id""")
add("M4_normalize_scores", "meta_id:s unit:d",
    lambda t: M.normalize_scores(t.raw_scored.withColumn("raw_score", -F.col("score")), out="unit").withColumn(
        "unit", F.round("unit", 6)),
    "SELECT meta_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS unit FROM raw_scored")
add("M5_threshold", "method:s theta:d",
    lambda t: M.threshold(t.raw_scored, method="iqr").withColumn("method", F.lit("iqr")).unionByName(
        M.threshold(t.raw_scored, method="percentile").withColumn("method", F.lit("percentile"))).unionByName(
        M.threshold(t.raw_scored, override=0.4).withColumn("method", F.lit("override"))),
    """SELECT 'iqr' AS method, theta FROM theta UNION ALL
      SELECT 'percentile', round(quantile_cont(score, 0.95), 4) FROM raw_scored UNION ALL SELECT 'override', 0.4""")
add("M6_contamination", "contamination:d", lambda t: M.contamination(t.metas),
    "SELECT least(greatest(avg(ground_truth), 0.0001), 0.5) AS contamination FROM metas")
add("M7_false_positive_gate", "meta_id:s gated:b",
    lambda t: t.raw_scored.withColumn("gated", M.false_positive_gate(F.col("score"), F.lit(0.4))),
    "SELECT meta_id, score >= 0.4 AND max_severity < 7 AND alert_count < 5 AND mitre_hit_count = 0 AS gated FROM raw_scored")
add("M8_decision_matrix", "meta_id:s anomaly_score:d decision:s action:s escalate:i", lambda t: t.scored,
    "SELECT * FROM scored")
add("M9_action_report", "decision:s action:s n:l pct:d", lambda t: M.action_report(t.scored),
    """SELECT decision, action, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored)::DOUBLE * 100, 4) AS pct
      FROM scored GROUP BY ALL""")
add("M9_score_report",
    "n_total:l n_escalate:l n_digest:l n_suppress:l reduction_pct:d score_min:d score_median:d score_q3:d score_max:d",
    lambda t: M.score_report(t.scored),
    """SELECT count(*) AS n_total, count(*) FILTER (action = 'ESCALATE') AS n_escalate,
      count(*) FILTER (action = 'DAILY_DIGEST') AS n_digest, count(*) FILTER (action = 'SUPPRESS') AS n_suppress,
      round(count(*) FILTER (action = 'SUPPRESS') / count(*)::DOUBLE * 100, 2) AS reduction_pct,
      min(anomaly_score) AS score_min, round(median(anomaly_score), 6) AS score_median,
      round(quantile_cont(anomaly_score, 0.75), 6) AS score_q3, max(anomaly_score) AS score_max FROM scored""")
add("M9_top_escalated", "meta_id:s anomaly_score:d decision:s", lambda t: M.top_anomalies(t.scored, 10),
    "SELECT * FROM scored WHERE escalate = 1 ORDER BY anomaly_score DESC, meta_id LIMIT 10")
add("M10_feature_contrast", "feature:s escalate:i mean_relative:d", lambda t: M.feature_contrast(t.scored),
    """SELECT feature, escalate, round(CASE WHEN m > 0 THEN avg(value) / m ELSE 0 END, 6) AS mean_relative FROM (
      SELECT feature, escalate, value, max(abs(value)) OVER (PARTITION BY feature) AS m FROM flong JOIN scored USING (meta_id))
      GROUP BY feature, escalate, m""")


def _pca(t: Tables) -> DataFrame:
    placed, (first, second) = forest.pca_2d(t.scaled)
    return placed.withColumns({"share1": F.lit(first), "share2": F.lit(second)})


add("M11_pca_2d", "meta_id:s pc1:d pc2:d share1:d share2:d", _pca)
add("M12_score_histogram", "escalate:i bin:i n:l", lambda t: M.score_histogram(t.scored),
    """SELECT escalate, least(CAST(floor(anomaly_score * 59) AS INTEGER), 58) AS bin, count(*) AS n FROM scored
      GROUP BY ALL""")
add("M12_group_escalations", "rule_groups:s n:l", lambda t: M.escalations_by_group(t.scored),
    """SELECT rule_groups, count(*) AS n FROM scored WHERE escalate = 1 GROUP BY ALL ORDER BY n DESC, rule_groups LIMIT 10""")

# ---- evaluation -----------------------------------------------------------------------------------

add("E1_reduction", "n_raw:l n_meta:l arr_pct:d", lambda t: E.reduction(t.alerts, t.metas),
    """SELECT (SELECT count(*) FROM alerts) AS n_raw, count(*) AS n_meta,
      round((1 - count(*) / (SELECT count(*) FROM alerts)::DOUBLE) * 100, 4) AS arr_pct FROM metas""")
add("E2_sensitivity_sweep", "delta_t_min:i n_raw:l n_meta:l arr_pct:d", lambda t: E.sensitivity_sweep(t.alerts),
    "SELECT * FROM sweep")
add("E3_elbow", "delta_t_min:i", lambda t: E.elbow(E.sensitivity_sweep(t.alerts)),
    """SELECT CASE WHEN max(bend) > 0.5 THEN arg_max(delta_t_min, bend) ELSE arg_max(delta_t_min, dist) END AS delta_t_min
      FROM (SELECT *, lead(arr_pct) OVER w - 2 * arr_pct + lag(arr_pct) OVER w AS bend,
        abs((arr_pct - min(arr_pct) OVER ()) / (max(arr_pct) OVER () - min(arr_pct) OVER () + 1e-9)
          - (delta_t_min - min(delta_t_min) OVER ()) / (max(delta_t_min) OVER () - min(delta_t_min) OVER () + 1e-9)) AS dist
        FROM sweep WINDOW w AS (ORDER BY delta_t_min))""")
add("E4_reduction_per_group",
    "rule_group:s n_raw:l n_meta_session:l arr_session_pct:d n_meta_fixed:l arr_fixed_pct:d delta_arr:d",
    lambda t: t.per_group, "SELECT * FROM per_group")
add("E5_loss_analysis",
    "rule_group:s raw_alerts:l fixed_n_meta:l session_n_meta:l arr_fixed_pct:d arr_session_pct:d delta_arr:d "
    "avg_alerts_fixed:d avg_alerts_session:d fixed_fragmented:l",
    lambda t: E.loss_analysis(t.alerts, t.metas, t.fixed),
    """SELECT rule_groups AS rule_group, raw_alerts, fixed_n_meta, session_n_meta,
      round((1 - fixed_n_meta / raw_alerts::DOUBLE) * 100, 1) AS arr_fixed_pct,
      round((1 - session_n_meta / raw_alerts::DOUBLE) * 100, 1) AS arr_session_pct,
      round((1 - session_n_meta / raw_alerts::DOUBLE) * 100 - (1 - fixed_n_meta / raw_alerts::DOUBLE) * 100, 1) AS delta_arr,
      avg_alerts_fixed, avg_alerts_session, fixed_fragmented
      FROM (SELECT rule_groups, count(*) AS raw_alerts FROM alerts GROUP BY ALL)
      JOIN (SELECT rule_groups, count(*) AS session_n_meta, round(avg(alert_count), 1) AS avg_alerts_session FROM metas
        GROUP BY ALL) USING (rule_groups)
      JOIN (SELECT rule_groups, count(*) AS fixed_n_meta, round(avg(alert_count), 1) AS avg_alerts_fixed,
        count(*) FILTER (alert_count < med / 2) AS fixed_fragmented FROM (
          SELECT *, median(alert_count) OVER (PARTITION BY rule_groups) AS med FROM fixed_metas) GROUP BY ALL)
        USING (rule_groups)""")
add("E6_fpr_sweep", "threshold:d reduction_pct:d fpr:d precision:d recall:d tp:l fn:l fp:l tn:l",
    lambda t: E.fpr_sweep(t.scored),
    """SELECT round(th, 3) AS threshold, round((fn + tn) / (tp + fn + fp + tn)::DOUBLE * 100, 2) AS reduction_pct,
      round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END, 4) AS fpr,
      round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS precision,
      round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 4) AS recall, * EXCLUDE (th)
      FROM (SELECT th, count(*) FILTER (ground_truth = 1 AND anomaly_score >= th) AS tp,
        count(*) FILTER (ground_truth = 1 AND anomaly_score < th) AS fn,
        count(*) FILTER (ground_truth = 0 AND anomaly_score >= th) AS fp,
        count(*) FILTER (ground_truth = 0 AND anomaly_score < th) AS tn
        FROM scored, (SELECT unnest(range(0, 41)) / 40.0::DOUBLE AS th) GROUP BY th)""")
PR = """(SELECT anomaly_score, p / n_pos::DOUBLE AS dr, tp / (tp + fp)::DOUBLE AS prec, tp / n_pos::DOUBLE AS rec FROM (
  SELECT *, sum(p) OVER (ORDER BY anomaly_score DESC) AS tp, sum(g) OVER (ORDER BY anomaly_score DESC) AS fp,
    sum(p) OVER () AS n_pos FROM (SELECT anomaly_score, sum(ground_truth) AS p, sum(1 - ground_truth) AS g FROM scored GROUP BY ALL)))"""
add("E7_pr_auc", "pr_auc:d", lambda t: E.pr_auc(t.scored), f"SELECT round(sum(dr * prec), 4) AS pr_auc FROM {PR}")
add("E8_pr_curve", "threshold:d precision:d recall:d", lambda t: E.pr_curve(t.scored),
    f"SELECT anomaly_score AS threshold, round(prec, 6) AS precision, round(rec, 6) AS recall FROM {PR}")
CONF = """(SELECT count(*) FILTER (ground_truth = 1 AND escalate = 1)::DOUBLE AS tp,
  count(*) FILTER (ground_truth = 1 AND escalate = 0)::DOUBLE AS fn, count(*) FILTER (ground_truth = 0 AND escalate = 1)::DOUBLE AS fp,
  count(*) FILTER (ground_truth = 0 AND escalate = 0)::DOUBLE AS tn FROM scored)"""
add("E9_fbeta", "f05:d f1:d", lambda t: E.fbeta(t.scored),
    f"""SELECT round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 4) AS f05, round(2 * tp / (2 * tp + fn + fp), 4) AS f1
      FROM {CONF}""")
add("E10_fnr", "fn:l tp:l fnr:d", lambda t: E.false_negative_rate(t.scored),
    f"SELECT fn, tp, round(fn / (tp + fn), 4) AS fnr FROM {CONF}")
add("E11_triage_load",
    "avg_alerts_per_meta_all:d avg_alerts_per_meta_escalate:d compression_ratio:d triage_load_reduction_pct:d",
    lambda t: E.triage_load(t.scored),
    """SELECT round(avg(alert_count), 2) AS avg_alerts_per_meta_all,
      round(avg(alert_count) FILTER (escalate = 1), 2) AS avg_alerts_per_meta_escalate,
      round(sum(alert_count) / count(*)::DOUBLE, 2) AS compression_ratio,
      round((1 - count(*) / sum(alert_count)::DOUBLE) * 100, 2) AS triage_load_reduction_pct FROM scored""")
add("E12_session_scorecard",
    "n_raw:l n_meta:l arr_pct:d compression_ratio:d low_severity_pct:d arr_min:d arr_max:d arr_mean:d "
    "n_below_expected:l n_below_unexpected:l",
    lambda t: E.session_scorecard(t.metas, t.per_group),
    """SELECT * FROM (SELECT sum(alert_count) AS n_raw, count(*) AS n_meta,
        round((1 - count(*) / sum(alert_count)::DOUBLE) * 100, 2) AS arr_pct,
        round(sum(alert_count) / count(*)::DOUBLE, 2) AS compression_ratio,
        round(count(*) FILTER (max_severity < 7) / count(*)::DOUBLE * 100, 2) AS low_severity_pct FROM metas),
      (SELECT min(arr_session_pct) AS arr_min, max(arr_session_pct) AS arr_max, round(avg(arr_session_pct), 4) AS arr_mean,
        count(*) FILTER (arr_session_pct < 80 AND rule_group = 'sudo') AS n_below_expected,
        count(*) FILTER (arr_session_pct < 80 AND rule_group <> 'sudo') AS n_below_unexpected FROM per_group)""")
add("E12_groups_below_target", "rule_group:s arr_session_pct:d expected_low:i",
    lambda t: E.groups_below_target(t.per_group, 83.0),
    """SELECT rule_group, arr_session_pct, CASE WHEN rule_group = 'sudo' THEN 1 ELSE 0 END AS expected_low FROM per_group
      WHERE arr_session_pct < 83""")
add("E13_model_scorecard", "n_total:l n_pos:l n_neg:l positive_pct:d pr_auc:d f05:d f1:d fnr:d",
    lambda t: E.model_scorecard(t.scored),
    f"""SELECT tp + fn + fp + tn AS n_total, tp + fn AS n_pos, fp + tn AS n_neg,
      round((tp + fn) / (tp + fn + fp + tn) * 100, 2) AS positive_pct,
      (SELECT round(sum(dr * prec), 4) FROM {PR}) AS pr_auc,
      round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 4) AS f05, round(2 * tp / (2 * tp + fn + fp), 4) AS f1,
      round(fn / (tp + fn), 4) AS fnr FROM {CONF}""")
add("E14_severity_dist", "max_severity:i n:l", lambda t: E.severity_distribution(t.metas),
    "SELECT max_severity, count(*) AS n FROM metas GROUP BY ALL")
add("E15_compression_hist", "bin:i n:l", lambda t: E.compression_histogram(t.metas),
    """SELECT least(CAST(floor((alert_count - lo) * 20 / (hi - lo)::DOUBLE) AS INTEGER), 19) AS bin, count(*) AS n FROM metas,
      (SELECT min(alert_count) AS lo, max(alert_count) AS hi FROM metas) GROUP BY ALL""")

# ---- perturbation ---------------------------------------------------------------------------------

add("X1_noise_rows", "noise_no:l ts_us:l agent_id:s agent_name:s rule_groups:s rule_level:i rule_id:i",
    lambda t: P.noise_rows(t.alerts, 0.10).withColumn("ts_us", us("timestamp")), "SELECT * FROM noise10")
SYN = "wazuh_alert_id:s ts_us:l agent_id:s agent_name:s rule_groups:s rule_level:i rule_id:i has_mitre:i mitre_tactic:s scenario_id:s"
ROWS_A = """SELECT 'SYN-A-0-' || i AS wazuh_alert_id, (lo_us + (hi_us - lo_us) * 30 // 100) // 1000000 * 1000000
    + i * 2000000 AS ts_us, '002' AS agent_id, 'pusatkarir' AS agent_name, 'authentication_failed' AS rule_groups,
    10 AS rule_level, 5716 AS rule_id, 0 AS has_mitre, '' AS mitre_tactic, 'A' AS scenario_id
  FROM span, (SELECT unnest(range(0, 50000)) AS i)"""
ROWS_B = """SELECT 'SYN-B-' || p || '-' || i AS wazuh_alert_id, (lo_us + (hi_us - lo_us) * 50 // 100) // 1000000 * 1000000
    + p * 300000000 + i * step * 1000000 AS ts_us, '007' AS agent_id, 'sads' AS agent_name, g AS rule_groups,
    lv AS rule_level, rid AS rule_id, 1 AS has_mitre, tac AS mitre_tactic, 'B' AS scenario_id
  FROM span, (SELECT 0 AS p, 4 AS step, 'authentication_failed' AS g, 8 AS lv, 5720 AS rid, 'Discovery' AS tac,
      unnest(range(0, 2000)) AS i
    UNION ALL SELECT 1, 6, 'web', 11, 31101, 'Initial Access', unnest(range(0, 1500))
    UNION ALL SELECT 2, 8, 'syscheck_file', 7, 553, 'Persistence', unnest(range(0, 1000)))"""
ROWS_C = """SELECT 'SYN-C-' || a || '-' || i AS wazuh_alert_id, (lo_us + (hi_us - lo_us) * 70 // 100) // 1000000 * 1000000
    + a * 900000000 + i * 3000000 AS ts_us, ['004','005','007','006','008','003','002','001'][a + 1] AS agent_id,
    ['siput','proxy-manager','sads','e-kuesioner','DVWA','dfir-iris','pusatkarir','soc-1'][a + 1] AS agent_name,
    'authentication_failed' AS rule_groups, 10 AS rule_level, 5763 AS rule_id, 1 AS has_mitre,
    'Lateral Movement' AS mitre_tactic, 'C' AS scenario_id
  FROM span, (SELECT unnest(range(0, 8)) AS a), (SELECT unnest(range(0, 50000)) AS i)"""
for _s, _rows in (("A", ROWS_A), ("B", ROWS_B), ("C", ROWS_C)):
    add(f"X{2 + 'ABC'.index(_s)}_template_rows_{_s}", SYN,
        lambda t, s=_s: P.template_rows(t.alerts, s).withColumn("ts_us", us("timestamp")), _rows)
add("X5_inject", "scenario_id:s is_synthetic:i n:l first_us:l last_us:l",
    lambda t: P.inject(t.alerts).groupBy("scenario_id", "is_synthetic").agg(
        F.count("*").alias("n"), F.min(us("timestamp")).alias("first_us"), F.max(us("timestamp")).alias("last_us")),
    f"""SELECT scenario_id, 1 AS is_synthetic, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us
      FROM ({ROWS_A} UNION ALL {ROWS_B} UNION ALL {ROWS_C}) GROUP BY ALL UNION ALL
      SELECT '', 0, count(*), min(ts_us), max(ts_us) FROM alerts""")
INJECTED = f"""(SELECT event_id, ts_us, agent_id, rule_groups, '' AS scenario_id FROM alerts UNION ALL
  SELECT -((64 + p + 1)::BIGINT << 40) - i AS event_id, ts_us, agent_id, rule_groups, scenario_id
  FROM ({ROWS_B.replace("AS wazuh_alert_id,", "AS wazuh_alert_id, p, i,")}) UNION ALL
  SELECT -((128 + a + 1)::BIGINT << 40) - i, ts_us, agent_id, rule_groups, scenario_id
  FROM ({ROWS_C.replace("AS wazuh_alert_id,", "AS wazuh_alert_id, a, i,")}))"""
SCALED = f"""(SELECT * FROM {INJECTED} WHERE event_id >= 0 OR (-event_id) % (1::BIGINT << 40) < CASE
  WHEN scenario_id = 'C' THEN 1000 ELSE [40, 30, 20][CAST((-event_id) >> 40 AS INTEGER) - 64] END)"""


def _injected(t: Tables) -> DataFrame:
    return P.inject(t.alerts, ("B", "C"), scale=0.02)


add("X5_inject_rows", "event_id:l ts_us:l arrival_us:l agent_id:s rule_groups:s scenario_id:s",
    lambda t: _injected(t).withColumn("ts_us", us("timestamp")), f"SELECT *, ts_us AS arrival_us FROM {SCALED}")


def _injected_labels(t: Tables) -> DataFrame:
    rows = _injected(t)
    assigned = A.assign_buckets(A.ordered_alerts(rows, 50, 60), GAP_15, None)
    return P.propagate_labels(A.meta_alerts(assigned), A.mapping(assigned), rows)


add("X6_injected_labels", "meta_id:s alert_count:l ground_truth:i scenario_id:s", _injected_labels,
    f"""SELECT agent_id || '|' || rule_groups || '|' || bstart AS meta_id, count(*) AS alert_count,
      max(CASE WHEN scenario_id <> '' THEN 1 ELSE 0 END) AS ground_truth,
      coalesce(min(nullif(scenario_id, '')), '') AS scenario_id
      FROM {Q._in_order(SCALED, 15)} GROUP BY agent_id, rule_groups, bstart""")
add("X6_propagate_labels", "meta_id:s ground_truth:i scenario_id:s",
    lambda t: P.propagate_labels(A.meta_alerts(t.capped), A.mapping(t.capped), t.alerts),
    "SELECT meta_id, ground_truth, scenario_id FROM metas_cap")
add("X7_robustness_sweep",
    "noise_rate:d n_original:l n_noise:l n_total:l n_meta:l arr_pct:d arr_degradation:d noise_absorbed:l noise_absorption_rt:d",
    lambda t: P.robustness_sweep(t.alerts),
    """SELECT noise_rate, n0 AS n_original, n_noise, n0 + n_noise AS n_total, n_meta,
      round((1 - n_meta / n0::DOUBLE) * 100, 2) AS arr_pct,
      round((1 - base / n0::DOUBLE) * 100 - (1 - n_meta / n0::DOUBLE) * 100, 2) AS arr_degradation, noise_absorbed,
      round(CASE WHEN n_noise > 0 THEN noise_absorbed * 100.0 / n_noise ELSE 0 END, 2) AS noise_absorption_rt
      FROM robust, (SELECT count(*) AS n0 FROM alerts), (SELECT n_meta AS base FROM robust WHERE noise_rate = 0)""")

# ---- profiling ------------------------------------------------------------------------------------

add("D1_overview", "n_alerts:l n_columns:l first_us:l last_us:l n_days:l n_agents:l n_groups:l n_rules:l",
    lambda t: D.overview(t.day_alerts),
    f"""SELECT count(*) AS n_alerts, {len(EVERY.split())} AS n_columns, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT local_date) AS n_days,
      count(DISTINCT agent_name) AS n_agents, count(DISTINCT rule_groups) AS n_groups, count(DISTINCT rule_id) AS n_rules
      FROM local""")
DIRTY_NULLS = {
    "timestamp_utc": "event_id % 61 = 1", "rule_group_primary": f"{D_GROUP} IS NULL", "rule_level": f"{D_LEVEL} IS NULL",
    "srcip": f"{D_IP} IS NULL", "srcip_type": "event_id % 31 = 0", "criticality_score": "event_id % 23 = 1",
    "has_critical_mitre": "event_id % 19 = 1 AND event_id % 19 <> 0",
}
DIRTY_WHOLE = ["event_id", "arrival_us", "agent_id", "agent_name", "rule_id", "has_mitre", "mitre_tactic", "wazuh_alert_id",
               "is_synthetic", "scenario_id"]
add("D2_null_profile", "column_name:s n_null:l pct:d mostly_null:i", lambda t: D.null_profile(t.dirty, t.dirty.columns),
    "SELECT c AS column_name, n AS n_null, round(n / t::DOUBLE * 100, 1) AS pct, CASE WHEN n > t / 2 THEN 1 ELSE 0 END AS "
    "mostly_null FROM (SELECT count(*) AS t FROM alerts), (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(*) AS n FROM alerts WHERE {rule}"
        for c, rule in [*DIRTY_NULLS.items(), *((c, "false") for c in DIRTY_WHOLE)]) + ")")


def _column_profile(t: Tables) -> DataFrame:
    """All columns, and one that holds nulls only."""
    rows = t.alerts.withColumn("no_value", F.lit(None).cast("string"))
    return D.column_profile(rows, rows.columns)


SPARK_NAMES = {"s": "string", "l": "bigint", "i": "int"}
add("D3_column_profile", "column_name:s dtype:s n_unique:l examples:s", _column_profile,
    "SELECT c AS column_name, dtype, count(v) AS n_unique, string_agg(v, ', ' ORDER BY v) FILTER (r <= 3) AS examples FROM ("
    "SELECT *, row_number() OVER (PARTITION BY c ORDER BY v) AS r FROM (" + " UNION ALL ".join(
        "SELECT DISTINCT 'timestamp' AS c, 'timestamp' AS dtype, CAST(make_timestamp(ts_us) AS VARCHAR) AS v FROM alerts"
        if c == "ts_us" else f"SELECT DISTINCT '{c}' AS c, '{SPARK_NAMES[k]}' AS dtype, CAST({c} AS VARCHAR) AS v FROM alerts"
        for c, k in (x.split(":") for x in EVERY.split())) + " UNION ALL SELECT 'no_value', 'string', NULL)) GROUP BY c, dtype")
add("D4_daily_volume", "local_date:s n:l rolling7:d", lambda t: D.daily_volume(t.day_alerts),
    """SELECT local_date, n, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 4) END AS rolling7 FROM (
      SELECT local_date, count(*) AS n FROM local GROUP BY ALL)
      WINDOW w AS (ORDER BY local_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
add("D4_daily_stats", "n_days:l mean:d std:d min:l q1:d median:d q3:d max:l quietest_day:s busiest_day:s",
    lambda t: D.daily_stats(t.day_alerts),
    """SELECT count(*) AS n_days, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS std, min(n) AS min,
      quantile_cont(n, 0.25) AS q1, median(n) AS median, quantile_cont(n, 0.75) AS q3, max(n) AS max,
      (SELECT local_date FROM local GROUP BY ALL ORDER BY count(*), local_date LIMIT 1) AS quietest_day,
      (SELECT local_date FROM local GROUP BY ALL ORDER BY count(*) DESC, local_date LIMIT 1) AS busiest_day
      FROM (SELECT local_date, count(*) AS n FROM local GROUP BY ALL)""")
HOURS = " ".join(f"h{h:02d}:l" for h in range(24))
HOURS_SQL = ", ".join(f"count(*) FILTER (local_hour = {h}) AS h{h:02d}" for h in range(24))
add("D5_day_hour_matrix", f"day_of_week:i {HOURS}", lambda t: D.day_hour_matrix(t.day_alerts),
    f"SELECT day_of_week, {HOURS_SQL} FROM local GROUP BY day_of_week")
add("D5_hourly_totals", "local_hour:i n:l busiest:i", lambda t: D.hourly_totals(t.day_alerts),
    """SELECT local_hour, n, CASE WHEN row_number() OVER (ORDER BY n DESC, local_hour) = 1 THEN 1 ELSE 0 END AS busiest
      FROM (SELECT local_hour, count(*) AS n FROM local GROUP BY ALL)""")
add("D6_iat_stats",
    "n_gaps:l median_sec:d mean_sec:d pct_lt_1s:d pct_lt_5s:d pct_lt_60s:d pct_lt_300s:d pct_lt_900s:d",
    lambda t: D.iat_stats(t.day_alerts),
    "SELECT count(*) AS n_gaps, round(median(gap_us) / 1000000, 6) AS median_sec, "
    "round(sum(gap_us) / count(*)::DOUBLE / 1000000, 6) AS mean_sec, "
    + ", ".join(f"round(count(*) FILTER (gap_us < {s}000000) / count(*)::DOUBLE * 100, 4) AS pct_lt_{s}s"
                for s in (1, 5, 60, 300, 900)) + " FROM gaps")
add("D6_iat_histogram", "bin:i n:l", lambda t: D.iat_histogram(t.day_alerts),
    "SELECT least(gap_us // 1000000, 59) AS bin, count(*) AS n FROM gaps WHERE gap_us <= 60000000 GROUP BY ALL")
add("D6_iat_log_histogram", "log10_sec:i n:l", lambda t: D.iat_log_histogram(t.day_alerts),
    "SELECT length(CAST(gap_us AS VARCHAR)) - 7 AS log10_sec, count(*) AS n FROM gaps GROUP BY ALL")
add("D7_agent_profile",
    "agent_name:s n:l avg_level:d max_level:i mitre_pct:d critical_mitre_pct:d n_rule_groups:l n_rule_ids:l criticality:i pct:d",
    lambda t: D.agent_profile(t.alerts),
    """SELECT agent_name, count(*) AS n, round(avg(rule_level), 4) AS avg_level, max(rule_level) AS max_level,
      round(avg(has_mitre) * 100, 4) AS mitre_pct, round(avg(has_critical_mitre) * 100, 4) AS critical_mitre_pct,
      count(DISTINCT rule_groups) AS n_rule_groups, count(DISTINCT rule_id) AS n_rule_ids,
      max(criticality_score) AS criticality, round(count(*) / (SELECT count(*) FROM alerts)::DOUBLE * 100, 4) AS pct
      FROM alerts GROUP BY agent_name""")
add("D8_month_agent_matrix", "month:s agent_name:s n:l", lambda t: D.month_agent_matrix(t.day_alerts),
    "SELECT month, agent_name, count(*) AS n FROM local GROUP BY ALL")
add("D9_group_share", "rule_groups:s n:l pct:d rank:i", lambda t: D.group_share(t.alerts),
    """SELECT rule_groups, n, round(n / sum(n) OVER ()::DOUBLE * 100, 4) AS pct,
      row_number() OVER (ORDER BY n DESC, rule_groups) AS rank FROM (SELECT rule_groups, count(*) AS n FROM alerts GROUP BY ALL)""")
add("D9_level_counts", "rule_level:i n:l pct:d cum_pct:d", lambda t: D.level_counts(t.alerts),
    """SELECT rule_level, n, round(n / sum(n) OVER ()::DOUBLE * 100, 4) AS pct,
      round(sum(n) OVER (ORDER BY rule_level) / sum(n) OVER ()::DOUBLE * 100, 4) AS cum_pct
      FROM (SELECT rule_level, count(*) AS n FROM alerts GROUP BY ALL)""")
AG = """(SELECT agent_name, rule_groups, count(*) AS n FROM alerts WHERE rule_groups IN (SELECT rule_groups FROM alerts
  GROUP BY ALL ORDER BY count(*) DESC, rule_groups LIMIT 12) GROUP BY ALL)"""
add("D10_agent_group_matrix", "agent_name:s rule_groups:s n:l row_pct:d", lambda t: D.agent_group_matrix(t.alerts),
    f"SELECT *, round(n / sum(n) OVER (PARTITION BY agent_name)::DOUBLE * 100, 4) AS row_pct FROM {AG}")
add("D10_dominant_group", "agent_name:s top_group:s pct:d", lambda t: D.dominant_group(t.alerts),
    f"""SELECT agent_name, rule_groups AS top_group, pct FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY agent_name)::DOUBLE
      * 100, 4) AS pct, row_number() OVER (PARTITION BY agent_name ORDER BY n DESC, rule_groups) AS r FROM {AG}) WHERE r = 1""")
add("D11_tactic_profile", "tactic:s n:l critical:i", lambda t: D.tactic_profile(t.alerts),
    """SELECT tactic, count(*) AS n, CASE WHEN tactic = 'Execution' THEN 1 ELSE 0 END AS critical FROM (
      SELECT unnest(string_split(mitre_tactic, '|')) AS tactic FROM alerts WHERE mitre_tactic <> '') GROUP BY ALL""")
add("D11_mitre_coverage", "agent_name:s n:l n_mitre:l n_critical:l mitre_pct:d critical_pct:d",
    lambda t: D.mitre_coverage(t.alerts),
    """SELECT a AS agent_name, count(*) AS n, sum(has_mitre) AS n_mitre, sum(has_critical_mitre) AS n_critical,
      round(avg(has_mitre) * 100, 4) AS mitre_pct, round(avg(has_critical_mitre) * 100, 4) AS critical_pct
      FROM (SELECT *, agent_name AS a FROM alerts UNION ALL SELECT *, '*' FROM alerts) GROUP BY a""")
add("D12_srcip_types", "srcip_type:s n:l pct:d", lambda t: D.srcip_types(t.alerts),
    """SELECT srcip_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM alerts)::DOUBLE * 100, 4) AS pct FROM alerts
      GROUP BY ALL""")
add("D12_top_ips", "srcip:s n:l",
    lambda t: I.top_k(t.alerts.where(F.col("srcip_type") == "internal"), ["srcip"], 10),
    """SELECT srcip, count(*) AS n FROM alerts WHERE srcip_type = 'internal' GROUP BY ALL ORDER BY n DESC, srcip LIMIT 10""")
add("D12_agent_srcip_matrix", "agent_name:s external:l internal:l none:l", lambda t: D.agent_srcip_matrix(t.alerts),
    """SELECT agent_name, count(*) FILTER (srcip_type = 'external') AS "external",
      count(*) FILTER (srcip_type = 'internal') AS "internal", count(*) FILTER (srcip_type = 'none') AS "none"
      FROM alerts GROUP BY agent_name""")
add("D12_subnet_counts", "subnet:s n:l", lambda t: D.subnet_counts(t.alerts),
    """SELECT CASE WHEN srcip LIKE '10.%' THEN '10.0.0' ELSE '192.168.1' END AS subnet, count(*) AS n FROM alerts
      WHERE srcip_type = 'internal' GROUP BY ALL""")
add("D12_shared_ips", "srcip:s n_agents:l n_alerts:l agents:s", lambda t: D.shared_ips(t.alerts),
    """SELECT srcip, count(DISTINCT agent_name) AS n_agents, count(*) AS n_alerts,
      array_to_string(list_sort(list(DISTINCT agent_name)), '|') AS agents FROM alerts WHERE srcip_type = 'internal'
      GROUP BY srcip HAVING count(DISTINCT agent_name) > 1""")
add("D13_rule_profile",
    "rule_id:i n:l avg_level:d max_level:i first_group:s description:s mitre_rate:d n_agents:l pct:d",
    lambda t: D.rule_profile(t.alerts.withColumn("rule_description", F.concat(F.lit("rule "), F.col("rule_id").cast("string")))),
    """SELECT rule_id, count(*) AS n, round(avg(rule_level), 4) AS avg_level, max(rule_level) AS max_level,
      (SELECT b.rule_groups FROM alerts b WHERE b.rule_id = a.rule_id ORDER BY b.arrival_us, b.event_id LIMIT 1) AS first_group,
      'rule ' || rule_id AS description, round(avg(has_mitre), 4) AS mitre_rate, count(DISTINCT agent_name) AS n_agents,
      round(count(*) / (SELECT count(*) FROM alerts)::DOUBLE * 100, 4) AS pct FROM alerts a GROUP BY rule_id""")
add("D13_agent_rule_repeats", "agent_name:s rule_id:i n:l first_group:s first_level:i",
    lambda t: D.agent_rule_repeats(t.alerts),
    """SELECT agent_name, rule_id, n, rule_groups AS first_group, rule_level AS first_level FROM (
      SELECT *, row_number() OVER (PARTITION BY agent_name, rule_id ORDER BY arrival_us, event_id) AS r,
        count(*) OVER (PARTITION BY agent_name, rule_id) AS n FROM alerts) WHERE r = 1
      ORDER BY n DESC, agent_name, rule_id LIMIT 30""")
add("D14_session_profile", "n_meta:l avg_alerts:d median_alerts:d max_alerts:l singleton_pct:d",
    lambda t: D.session_profile(t.metas),
    """SELECT count(*) AS n_meta, round(avg(alert_count), 4) AS avg_alerts, median(alert_count) AS median_alerts,
      max(alert_count) AS max_alerts, round(count(*) FILTER (alert_count = 1) / count(*)::DOUBLE * 100, 4) AS singleton_pct
      FROM metas""")
add("D14_agent_reduction", "agent_name:s n_raw:l n_meta:l arr_pct:d", lambda t: D.agent_reduction(t.alerts, t.metas),
    """SELECT agent_name, n_raw, n_meta, round((1 - n_meta / n_raw::DOUBLE) * 100, 4) AS arr_pct
      FROM (SELECT agent_name, count(*) AS n_raw FROM alerts GROUP BY ALL)
      JOIN (SELECT agent_name, count(*) AS n_meta FROM metas GROUP BY ALL) USING (agent_name)""")
add("D14_duration_histogram", "bin:l n:l", lambda t: D.duration_histogram(t.metas),
    "SELECT duration_sec // 300 AS bin, count(*) AS n FROM metas GROUP BY ALL")
ENC = """(SELECT rule_level, criticality_score, has_mitre, has_critical_mitre, CASE rule_groups WHEN 'syslog' THEN 1
  WHEN 'sudo' THEN 2 WHEN 'syscheck_file' THEN 3 ELSE 4 END AS group_enc FROM alerts)"""
PAIRS = [(a, b) for i, a in enumerate(D.CORRELATED) for b in D.CORRELATED[i + 1:]]
add("D15_correlation", "x:s y:s r:d", lambda t: D.correlation(t.alerts),
    " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {ENC}" for a, b in PAIRS))
add("D15_moments", "column_name:s mean:d std:d min:i max:i skew:d zero_pct:d", lambda t: D.moments(t.alerts),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        max({c}) AS max, round(skewness({c}), 4) AS skew, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END) * 100, 4) AS zero_pct
        FROM {ENC}""" for c in D.CORRELATED))
add("D16_high_sev_pairs", "agent_name:s rule_groups:s n:l max_level:i criticality:i",
    lambda t: D.high_severity_pairs(t.alerts),
    """SELECT agent_name, rule_groups, count(*) AS n, max(rule_level) AS max_level, max(criticality_score) AS criticality
      FROM alerts WHERE rule_level >= 10 GROUP BY ALL ORDER BY criticality DESC, n DESC, agent_name, rule_groups LIMIT 20""")
add("D17_group_summary", "rule_groups:s n:l avg_level:d mitre_pct:d enc:i uses_default:i",
    lambda t: D.group_summary(t.alerts),
    """SELECT rule_groups, count(*) AS n, round(avg(rule_level), 4) AS avg_level, round(avg(has_mitre) * 100, 4) AS mitre_pct,
      CASE rule_groups WHEN 'syslog' THEN 1 WHEN 'sudo' THEN 2 WHEN 'syscheck_file' THEN 3 ELSE 4 END AS enc,
      0 AS uses_default FROM alerts GROUP BY rule_groups""")
add("D17_encoded_levels", "enc:i n:l", lambda t: D.encoded_level_counts(t.alerts),
    f"SELECT group_enc AS enc, count(*) AS n FROM {ENC} GROUP BY ALL")
add("D18_quality_flags",
    "n_alerts:l n_days:l single_day:i top_agent:s top_agent_pct:d agent_dominates:i top_group:s top_group_pct:d group_imbalance:i",
    lambda t: D.quality_flags(t.alerts),
    """SELECT n AS n_alerts, d AS n_days, CASE WHEN d <= 1 THEN 1 ELSE 0 END AS single_day, a.agent_name AS top_agent,
      round(a.c / n::DOUBLE * 100, 4) AS top_agent_pct, CASE WHEN a.c / n::DOUBLE > 0.3 THEN 1 ELSE 0 END AS agent_dominates,
      g.rule_groups AS top_group, round(g.c / n::DOUBLE * 100, 4) AS top_group_pct,
      CASE WHEN g.c / n::DOUBLE > 0.5 THEN 1 ELSE 0 END AS group_imbalance
      FROM (SELECT count(*) AS n, count(DISTINCT CAST(make_timestamp(ts_us) AS DATE)) AS d FROM alerts),
      (SELECT agent_name, count(*) AS c FROM alerts GROUP BY ALL ORDER BY c DESC, agent_name LIMIT 1) a,
      (SELECT rule_groups, count(*) AS c FROM alerts GROUP BY ALL ORDER BY c DESC, rule_groups LIMIT 1) g""")
add("D18_criticality_counts", "criticality_score:i n:l", lambda t: D.criticality_counts(t.alerts),
    "SELECT criticality_score, count(*) AS n FROM alerts GROUP BY ALL")
add("D19_anomaly_levels", "max_severity:i n:l n_escalated:l escalated_pct:d", lambda t: D.anomaly_levels(t.scored),
    """SELECT max_severity, count(*) AS n, sum(escalate) AS n_escalated,
      round(sum(escalate) / count(*)::DOUBLE * 100, 4) AS escalated_pct FROM scored GROUP BY ALL""")
add("D19_anomalous_agents", "agent_name:s n:l", lambda t: D.anomalous_agents(t.scored),
    """SELECT agent_name, count(*) AS n FROM scored WHERE escalate = 1 GROUP BY ALL ORDER BY n DESC, agent_name LIMIT 5""")
