"""Structured Streaming forms of the session, window and counting operators.

Spark advances its watermark per micro-batch, the batch operators per alert; batch is the exact form, these are its
continuous approximation. A session is emitted once the watermark has passed its end plus the gap.
"""

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alertfold.operators import decide, features, sessions, windows
from alertfold.schema import HIGH_SEVERITY, MICROS, MINUTE_US
from alertfold.session import ensure_checkpoint_dir


def watermarked(alerts: DataFrame, lateness_sec: float) -> DataFrame:
    """Rows more than twice the allowed lateness behind are dropped, as in batch."""
    return alerts.withWatermark("timestamp", f"{int(2 * lateness_sec * 1000)} milliseconds")


def dedup_stream(alerts: DataFrame, alert_id: str = "wazuh_alert_id") -> DataFrame:
    return alerts.dropDuplicatesWithinWatermark([alert_id])


def session_stream(alerts: DataFrame, gap_minutes: int) -> DataFrame:
    """Uncapped meta-alerts. Sessions are merged inside each input partition before the shuffle, so a hot key is
    combined where its rows are."""
    alerts.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = sessions.with_key(alerts)
    window = F.session_window("timestamp", f"{gap_minutes} minutes")
    out = rows.groupBy("agent_id", "rule_groups", window).agg(
        F.count("*").alias("alert_count"), F.max("rule_level").alias("max_severity"),
        F.sum(F.col("has_mitre").cast("long")).alias("mitre_hit_count"), F.max("timestamp").alias("last"))
    return out.select(
        "agent_id", "rule_groups", F.unix_micros("session_window.start").alias("start_us"),
        F.unix_micros("last").alias("end_us"), "alert_count", "max_severity", "mitre_hit_count")


CAPPED_OUTPUT = (
    "agent_id string, rule_groups string, start_us long, parent_start_us long, end_us long, alert_count long, "
    "max_severity int, mitre_hit_count long"
)
CAPPED_STATE = "start_us long, parent_start_us long, end_us long, alert_count long, max_severity int, mitre_hit_count long"


def capped_session_stream(alerts: DataFrame, gap_minutes: int, cap_minutes: int) -> DataFrame:
    """Meta-alerts split at the cap. The state of a key is one open bucket; a micro-batch first folds equal times, so
    that a key's share of a batch is bounded by the distinct times it covers."""
    gap, cap = gap_minutes * MINUTE_US, cap_minutes * MINUTE_US
    names = [c.split()[0] for c in CAPPED_OUTPUT.split(", ")]

    def fold(key: tuple, batches, state: GroupState):
        bucket = list(state.get) if state.exists else None
        closed = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([[*key, *bucket]], columns=names)
            return
        parts = [
            b.groupby("ts_us").agg(n=("rule_level", "size"), level=("rule_level", "max"), mitre=("has_mitre", "sum"))
            for b in batches
        ]
        rows = pd.concat(parts).groupby("ts_us").agg({"n": "sum", "level": "max", "mitre": "sum"}).sort_index()
        for t, n, level, mitre in rows.itertuples():
            t, n, level, mitre = int(t), int(n), int(level), int(mitre)
            if bucket is not None and t - bucket[2] <= gap and t - bucket[0] <= cap:
                bucket[2] = max(bucket[2], t)
                bucket[3:] = [bucket[3] + n, max(bucket[4], level), bucket[5] + mitre]
                continue
            parent = t  # a bucket that continues none names itself
            if bucket is not None:
                closed.append([*key, *bucket])
                parent = bucket[0] if t - bucket[2] <= gap else t
            bucket = [t, parent, t, n, level, mitre]
        state.update(tuple(bucket))
        state.setTimeoutTimestamp(max((bucket[2] + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame(closed, columns=names)

    rows = sessions.with_key(alerts).select(
        "timestamp", "agent_id", "rule_groups", F.unix_micros("timestamp").alias("ts_us"), "rule_level", "has_mitre")
    out = rows.groupBy("agent_id", "rule_groups").applyInPandasWithState(
        fold, CAPPED_OUTPUT, CAPPED_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    continues = F.col("parent_start_us") != F.col("start_us")
    return out.withColumn("parent_start_us", F.when(continues, F.col("parent_start_us")))


def compound_stream(alerts: DataFrame, minutes: int) -> DataFrame:
    """Per-agent tumbling windows."""
    return alerts.groupBy("agent_id", F.window("timestamp", f"{minutes} minutes")).agg(
        F.count("*").alias("alert_count"), F.max("rule_level").alias("max_severity"),
        F.sum(F.col("has_mitre").cast("long")).alias("mitre_hit_count")).select(
        "agent_id", F.unix_micros("window.start").alias("window_start_us"), "alert_count", "max_severity",
        "mitre_hit_count")


def count_stream(alerts: DataFrame) -> DataFrame:
    """Running counts, for the complete or update mode."""
    return windows.stream_counts(alerts)


def high_severity_stream(alerts: DataFrame, level: int = HIGH_SEVERITY) -> DataFrame:
    """Stateless capture of severe alerts."""
    return alerts.where(F.col("rule_level") >= level)


def lateness_batches(lateness_sec: float, sink, state: str | None = None):
    """``foreachBatch`` handler that adds the lateness class against the newest time ever seen.

    ``state`` is a folder in shared storage (a new one below the shared folder if not given). Batch ``n`` leaves the newest
    time up to itself there as one row, which batch ``n + 1`` reads; a batch that is run again finds the same. Only where no
    earlier batch left one does lateness start anew; a lost row is an error.
    """
    allowed = int(lateness_sec * MICROS)
    place = [state]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if place[0] is None:
            place[0] = _folder(spark, "newest")
        newest = batch.agg(F.max(F.unix_micros("timestamp")).alias("newest"))
        if batch_id > 0:
            try:
                before = spark.read.schema("newest long").parquet(f"{place[0]}/batch-{batch_id - 1}")
                newest = newest.unionByName(before).agg(F.max("newest").alias("newest"))
            except AnalysisException:
                if _has_earlier(spark, place[0], batch_id):  # that of the batch before is lost
                    raise
        newest.coalesce(1).write.mode("overwrite").parquet(f"{place[0]}/batch-{batch_id}")
        newest = spark.read.schema("newest long").parquet(f"{place[0]}/batch-{batch_id}")
        behind = F.col("newest") - F.unix_micros("timestamp")
        label = F.when(behind <= allowed, "on_time").when(behind <= 2 * allowed, "late_ok").otherwise("late_drop")
        sink(batch.crossJoin(F.broadcast(newest)).withColumn("lateness", label).drop("newest"), batch_id)
    return handle


def _has_earlier(spark: SparkSession, place: str, batch_id: int) -> bool:
    try:
        left = spark.read.schema("newest long").parquet(f"{place}/batch-*")
    except AnalysisException:  # no batch at all
        return False
    number = F.regexp_extract("_metadata.file_path", r"/batch-(\d+)/", 1).cast("long")
    return not left.where(number < batch_id).isEmpty()


def score_batches(gap_minutes: int, scorer, sink):
    """``foreachBatch`` handler: fold a micro-batch, derive features, apply a ``DataFrame -> DataFrame`` scorer with a
    ``score`` column, decide, and hand the escalated meta-alerts to ``sink(frame, batch_id)``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        kept: list[DataFrame] = []
        try:
            metas = features.enrich(sessions.fold_in_order(batch, gap_minutes * MINUTE_US), kept)
            scored = scorer(metas)
            decided = decide.decide(scored, decide.threshold(scored))
            sink(decide.escalated(decided), batch_id)
        finally:
            for frame in kept:
                frame.unpersist()
    return handle


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now and read back what it wrote to the shared folder."""
    spark = stream.sparkSession
    out, state = _folder(spark, name), _folder(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
