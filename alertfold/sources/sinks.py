"""Writing alerts, meta-alerts, payloads and summary tables."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from alertfold import schema as S
from alertfold.operators.relational import dedup_alerts


ARRIVAL = ("arrival_us", "event_id")


def write_monthly(
    alerts: DataFrame, path: str, columns: list[str] = S.FULL_COLUMNS, minimal_path: str | None = None,
) -> None:
    """One folder per year and month, and with ``minimal_path`` the minimal layer beside it in the same form.

    Rows are spread over the months' files by time, so that a busy month is written by many tasks. Arrival columns are
    stored with the rows where there are any.
    """
    known = [c for c in ARRIVAL if c in alerts.columns]
    month = [F.year("timestamp_utc").alias("year"), F.month("timestamp_utc").alias("month")]
    for names, where in ((columns, path), (S.MINIMAL_COLUMNS, minimal_path)):
        if where is not None:
            alerts.select(*names, *known, *month).repartitionByRange("year", "month", "timestamp_utc").write.mode(
                "overwrite").partitionBy("year", "month").parquet(where)


def write_consolidated(monthly: DataFrame, path: str, alert_id: str = "wazuh_alert_id") -> None:
    """Dedup over all months and write one dataset whose files are ordered by time.

    Of copies the first arrival stays; without arrival columns that is the earliest time. The result of the dedup is kept
    while it is written, as the range split reads it twice.
    """
    order = ARRIVAL if set(ARRIVAL) <= set(monthly.columns) else ("timestamp_utc", alert_id)
    merged = dedup_alerts(monthly, alert_id, order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        merged.repartitionByRange("timestamp_utc", alert_id).sortWithinPartitions("timestamp_utc", alert_id).write.mode(
            "overwrite").parquet(path)
    finally:
        merged.unpersist()


def as_json_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each row as one JSON line; nulls are written, timestamps as text."""
    stamps = {n for n, t in df.dtypes if t.startswith("timestamp")}
    cols = [
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c in stamps else F.col(c)
        for c in (columns or df.columns)
    ]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    as_json_lines(df).write.mode("overwrite").text(path)


def write_messages(messages: DataFrame, path: str, column: str = "message") -> None:
    """Multi-line messages, one JSON string per line so that line breaks stay inside a record."""
    messages.select(F.to_json(F.struct("meta_id", column)).alias("value")).write.mode("overwrite").text(path)


def write_payloads(payloads: DataFrame, path: str) -> None:
    payloads.select(F.col("payload").alias("value")).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small, already aggregated table as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)  # only the finished rows meet in one task


def write_meta_csv(metas: DataFrame, path: str) -> None:
    """Meta-alerts as CSV files with a header each, as many as there are tasks."""
    metas.write.mode("overwrite").option("header", True).csv(path)


def write_scored(scored: DataFrame, path: str, columns: list[str]) -> None:
    scored.select(*columns).write.mode("overwrite").parquet(path)
