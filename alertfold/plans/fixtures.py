"""Views over the given tables in the shapes the alert operators expect.

``events`` carries the timeline, so every view grows with it. Only integer arithmetic is used for derived times and
keys, which keeps the views reproducible in any SQL engine.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertfold import schema as S
from alertfold.functions import scalar as X

BASE_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z

AGENT_NAMES = list(S.AGENT_IDS)
EVENT_GROUPS = {
    "error": "authentication_failed", "click": "web", "view": "syslog", "purchase": "syscheck_file", "signup": "sudo",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str, compress: int = 60) -> DataFrame:
    """Alerts derived from ``events``; ``compress`` divides the timeline (30 days become 12 hours by default)."""
    return alerts_from(table(spark, sf_dir, "events"), compress)


def alerts_from(ev: DataFrame, compress: int = 60) -> DataFrame:
    """The same view of any ``events`` frame, batch or streaming."""
    elapsed = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    names = F.array(*[F.lit(n) for n in AGENT_NAMES])
    agent_no = (F.col("user_id") % 8).cast("int")
    octet = (F.col("user_id") % 25).cast("string")  # so that agents share addresses
    ip_kind = F.col("event_id") % 4
    ev = ev.select("event_id", "user_id", "event_type", "value", elapsed.alias("elapsed_us"))
    ev = ev.withColumn("off_us", F.expr(f"elapsed_us div {compress}") if compress > 1 else F.col("elapsed_us"))
    jitter = F.when(F.col("event_id") % 50 == 0, 4_000_000).otherwise(50_000)
    flat = ev.select(
        "event_id",
        F.timestamp_micros(F.lit(BASE_US) + F.col("off_us")).alias("timestamp"),
        (F.col("off_us") + (F.col("event_id") * 7919) % 97 * jitter).alias("arrival_us"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("wazuh_alert_id"),
        F.lpad((agent_no + 1).cast("string"), 3, "0").alias("agent_id"),
        F.get(names, agent_no).alias("agent_name"),
        X.literal_map(EVENT_GROUPS)[F.col("event_type")].alias("rule_groups"),
        F.least(F.lit(15), F.floor(F.col("value") / 20).cast("int")).alias("rule_level"),
        (1000 + F.col("event_id") % 7).cast("int").alias("rule_id"),
        F.when(ip_kind == 0, "")
        .when(ip_kind == 1, F.concat(F.lit("10.0.0."), octet))
        .when(ip_kind == 2, F.concat(F.lit("192.168.1."), octet))
        .otherwise(F.concat(F.lit("203.0.113."), octet)).alias("srcip"),
        F.when(F.col("event_id") % 11 == 0, "Execution|Persistence")
        .when(F.col("event_id") % 7 == 0, "Discovery").otherwise("").alias("mitre_tactic"),
        F.when(F.col("event_id") % 97 == 0, 1).otherwise(0).alias("is_synthetic"),
        F.when(F.col("event_id") % 97 == 0, "A").otherwise("").alias("scenario_id"),
    )
    tactics = F.when(F.col("mitre_tactic") == "", F.array().cast("array<string>")).otherwise(
        F.split("mitre_tactic", r"\|"))
    return flat.select(
        "*",
        X.srcip_type(F.col("srcip")).alias("srcip_type"),
        X.has_tactic(tactics).alias("has_mitre"),
        X.has_critical_tactic(tactics).alias("has_critical_mitre"),
        X.criticality_of_label(X.criticality_label(F.col("agent_name"))).alias("criticality_score"),
    )


def day_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alerts on their uncompressed 30-day timeline."""
    return alerts(spark, sf_dir, compress=1)


def dup_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts plus a later second copy of every tenth."""
    base = alerts(spark, sf_dir)
    again = base.where(F.col("event_id") % 10 == 0).withColumn("arrival_us", F.col("arrival_us") + 600_000_000)
    return base.unionByName(again)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts rendered as source JSON lines, with six kinds of broken line and five of mistyped fields mixed in."""
    a = alerts(spark, sf_dir)
    bad = F.col("event_id") % 101
    groups = F.when(bad == 5, F.array().cast("array<string>")).when(
        F.col("event_id") % 3 == 0, F.array(F.lit("ossec"), F.col("rule_groups"))).otherwise(
        F.array(F.col("rule_groups"), F.lit("local")))
    tactics = F.when(F.col("mitre_tactic") == "", F.array().cast("array<string>")).otherwise(
        F.split("mitre_tactic", r"\|"))
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    record = F.to_json(F.struct(
        F.when(bad == 2, "").when(bad == 3, "not-a-time").otherwise(iso).alias("timestamp"),
        F.col("wazuh_alert_id").alias("id"),
        F.concat(F.lit("/var/log/"), F.col("rule_groups")).alias("location"),
        F.concat(F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int")), F.col("wazuh_alert_id")).alias("full_log"),
        F.struct((F.col("event_id") % 8 + 1).cast("string").alias("id"), F.col("agent_name").alias("name"),
                 F.lit("10.1.1.1").alias("ip")).alias("agent"),
        F.struct(
            F.when(bad == 4, "").otherwise(F.col("rule_id").cast("string")).alias("id"),
            F.col("rule_level").alias("level"),
            F.concat(F.lit("rule "), F.col("rule_id").cast("string")).alias("description"),
            (F.col("event_id") % 5 + 1).cast("int").alias("firedtimes"),
            groups.alias("groups"),
            F.struct(tactics.alias("tactic"), F.array().cast("array<string>").alias("technique"),
                     F.array(F.lit("T1059")).alias("id")).alias("mitre"),
        ).alias("rule"),
        F.struct(F.when(F.col("srcip") != "", F.col("srcip")).alias("srcip"), F.lit("/index").alias("url")).alias("data"),
        F.struct(F.lit("sshd").alias("name")).alias("decoder"),
        F.struct(F.lit("mgr").alias("name")).alias("manager"),
    ))
    # Accepted all the same: a level as text, a level with a fraction, a count in words, texts where objects belong.
    quoted = F.regexp_replace(record, '"level":([0-9]+)', '"level":"$1"')
    fraction = F.regexp_replace(record, '"level":([0-9]+)', '"level":$1.0')
    words = F.regexp_replace(record, '"firedtimes":[0-9]+', '"firedtimes":"many"')
    flat = F.regexp_replace(record, '"data":\\{[^}]*\\}', '"data":"x","syscheck":[]')
    audit = F.regexp_replace(record, '"data":\\{', '"data":{"audit":"x",')
    record = F.when(bad == 6, quoted).when(bad == 7, fraction).when(bad == 8, words).when(bad == 9, flat).when(
        bad == 10, audit).otherwise(record)
    line = F.when(bad == 0, "  ").when(bad == 1, F.substring(record, 1, 40)).otherwise(record)
    return a.select("event_id", F.explode(F.array(line)).alias("value"))  # rendered once, however often it is read


def dirty_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text alerts in stored column names with the usual defects, keyed by ``event_id``."""
    a = alerts(spark, sf_dir)
    e = F.col("event_id")
    text = lambda c: F.col(c).cast("string")
    null = F.lit(None).cast("string")
    return a.select(
        "event_id", "arrival_us",
        F.when(e % 61 == 0, "broken").when(e % 61 == 1, null)
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp_utc"),
        F.when(e % 53 == 0, "md5").when(e % 53 == 1, "host-x").when(e % 53 == 2, "DVWA")
        .otherwise(F.col("agent_id")).alias("agent_id"),
        "agent_name",
        F.when(e % 43 == 0, null).when(e % 43 == 1, F.concat(F.lit("  "), F.upper("rule_groups"), F.lit(" ")))
        .otherwise(F.col("rule_groups")).alias("rule_group_primary"),
        F.when(e % 41 == 0, "99").when(e % 41 == 1, null).when(e % 41 == 2, "x")
        .otherwise(text("rule_level")).alias("rule_level"),
        F.when(e % 37 == 0, "nan").when(e % 37 == 1, null).otherwise(F.col("srcip")).alias("srcip"),
        F.when(e % 31 == 0, null).otherwise(F.col("srcip_type")).alias("srcip_type"),
        F.when(e % 29 == 0, "n/a").otherwise(text("rule_id")).alias("rule_id"),
        F.when(e % 23 == 0, "9").when(e % 23 == 1, null).otherwise(text("criticality_score")).alias("criticality_score"),
        F.when(e % 19 == 0, "2").otherwise(text("has_mitre")).alias("has_mitre"),
        F.when(e % 19 == 1, null).otherwise(text("has_critical_mitre")).alias("has_critical_mitre"),
        "mitre_tactic", "wazuh_alert_id", text("is_synthetic").alias("is_synthetic"), "scenario_id",
    )
