"""Reading alerts: nested JSON lines, stored CSV, exported JSON lines and file streams."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from alertfold import schema as S
from alertfold.functions import scalar as X

REJECT_REASONS = ["blank", "json_error", "empty_timestamp", "bad_timestamp", "no_rule_id", "no_rule_groups"]


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add the parsed ``record``, its ``ts`` and the first ``reject_reason`` that applies (null when accepted).

    An optional field of another type than expected counts as absent. ``json_error`` is text that isn't a JSON object.
    """
    raw = T.StructType([*S.RAW_ALERT.fields, T.StructField("_corrupt", T.StringType())])
    text = F.trim(F.col(value))
    record = F.from_json(text, raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # A generator is evaluated once per row; as a plain column the parse would be repeated for every field used.
    parsed = lines.select("*", F.explode(F.array(record)).alias("record"))
    stamp = F.col("record.timestamp")
    parsed = parsed.withColumn("ts", F.try_to_timestamp(stamp))
    reason = (
        F.when(text.isNull() | (text == ""), "blank")
        .when(F.col("record").isNull() | F.col("record._corrupt").isNotNull() & ~_is_object(text), "json_error")
        .when(F.coalesce(stamp, F.lit("")) == "", "empty_timestamp")
        .when(F.col("ts").isNull(), "bad_timestamp")
        .when(F.coalesce(F.col("record.rule.id"), F.lit("")) == "", "no_rule_id")
        .when(F.coalesce(F.size("record.rule.groups"), F.lit(0)) <= 0, "no_rule_groups")
    )
    return parsed.withColumn("reject_reason", reason)


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def _whole(field: str, default: int) -> Column:
    """A whole number from a JSON number or its text; a fraction is cut off."""
    return F.coalesce(F.col(f"record.{field}").try_cast("double").try_cast("int"), F.lit(default))


def _text(field: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"record.{field}"), F.lit(default))


def _joined(field: str) -> Column:
    return F.coalesce(F.array_join(f"record.{field}", "|"), F.lit(""))


def alert_columns() -> dict[str, Column]:
    """All columns of the full layer, as expressions over ``record`` and ``ts``."""
    rule, ip = "record.rule", F.col("record.data.srcip")
    name = _text("agent.name", "unknown")
    return {
        "wazuh_alert_id": _text("id"),
        "timestamp_utc": F.col("ts"),
        "agent_id": X.pad_agent_id(_text("agent.id", "000")),
        "agent_name": name,
        "rule_group_primary": X.primary_group(F.col(f"{rule}.groups")),
        "rule_level": _whole("rule.level", 0),
        "rule_id": F.col(f"{rule}.id"),
        "srcip": F.when(ip != "", ip),
        "srcip_type": X.srcip_type(ip),
        "criticality_score": X.criticality_of_label(X.criticality_label(name)),
        "has_mitre": X.has_tactic(F.col(f"{rule}.mitre.tactic")),
        "has_critical_mitre": X.has_critical_tactic(F.col(f"{rule}.mitre.tactic")),
        "agent_criticality": X.criticality_label(name),
        "mitre_tactic": _joined("rule.mitre.tactic"),
        "mitre_technique": _joined("rule.mitre.technique"),
        "mitre_id": _joined("rule.mitre.id"),
        "syscheck_event": _text("syscheck.event"),
        "syscheck_path": _text("syscheck.path"),
        "syscheck_mode": _text("syscheck.mode"),
        "rule_description": _text("rule.description"),
        "rule_groups_all": F.to_json(f"{rule}.groups"),
        "rule_firedtimes": _whole("rule.firedtimes", 1),
        "agent_ip": _text("agent.ip"),
        "decoder_name": _text("decoder.name"),
        "location": _text("location"),
        "data_url": _text("data.url"),
        "audit_command": _text("data.audit.command"),
        "manager_name": _text("manager.name"),
        "full_log": _text("full_log"),
    }


def accepted(parsed: DataFrame, columns: list[str] = S.FULL_COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    exprs = alert_columns()
    return parsed.where(F.col("reject_reason").isNull()).select(*keep, *[exprs[c].alias(c) for c in columns])


def rejected(parsed: DataFrame, value: str = "value") -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select(value, "reject_reason")


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Rows per reason; accepted rows are counted as ``accepted``."""
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def read_alert_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines from files or globs, parsed, with the file of each line."""
    return parse_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def with_month(lines: DataFrame, file: str = "file") -> DataFrame:
    """Year and month folder of each line's file, below ``<year>/<month>/``."""
    part = lambda i: F.regexp_extract(file, r"/(\d{4})/([^/]+)/", i)
    return lines.withColumns({"year": part(1), "month": part(2)})


def scan_month_dirs(spark: SparkSession, root: str, names: str = "*.json") -> DataFrame:
    """Lines below ``root/<year>/<month>/`` at any depth, with their year and month."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(root)
    lines = files.select("value", F.col("_metadata.file_path").alias("file"))
    return with_month(parse_lines(lines))


def parse_alert_csv(
    spark: SparkSession, path: str, columns: list[str] = S.FULL_COLUMNS, multi_line: bool = True,
) -> DataFrame:
    """Stored alert rows as text with ``_line``, the text of a row whose number of fields is not that of the header, and
    ``reject_reason``: ``too_many_fields``, or null. A short row is kept, its missing fields are null.

    Quotes inside fields are doubled. ``multi_line`` allows line breaks inside quoted fields; a file is then one task, so
    switch it off for large files without such fields. Every column is parsed, whichever are selected afterwards.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_beyond", "_line"]])
    rows = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
            .option("columnNameOfCorruptRecord", "_line").option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).csv(path))
    # One field too many fits the schema exactly; a row of the right length is one short of it.
    too_many = F.col("_line").isNull() | F.col("_beyond").isNotNull()
    return rows.select(*columns, "_line", F.when(too_many, "too_many_fields").alias("reject_reason"))


def read_alert_csv(
    spark: SparkSession, path: str, columns: list[str] = S.FULL_COLUMNS, multi_line: bool = True,
) -> DataFrame:
    """The rows of :func:`parse_alert_csv` that are not rejected; ``reject_counts`` of the same frame counts both."""
    return parse_alert_csv(spark, path, columns, multi_line).where(F.col("reject_reason").isNull()).select(*columns)


def read_alert_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Stored alert rows with their arrival order.

    Rows that were stored with ``arrival_us`` and ``event_id`` keep them. Otherwise files are ranked by year, month and
    part number, all as numbers, and rows by their position: both columns are the file's rank and the row's position in
    one number. Only the list of file names, one row per file, is ranked in a single task.
    """
    stored = spark.read.parquet(path)
    if {"arrival_us", "event_id"} <= set(stored.columns):
        return stored
    rows = stored.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    number_in = lambda pattern: F.coalesce(F.expr("nullif({}, '')".format(f"regexp_extract(_file, '{pattern}', 1)")).cast("long"), F.lit(0))
    by_number = Window.orderBy(number_in("year=([0-9]+)"), number_in("month=([0-9]+)"), number_in("part-([0-9]+)"), "_file")
    files = rows.select("_file").distinct().withColumn("_rank", F.row_number().over(by_number))
    number = F.shiftleft(F.col("_rank").cast("long"), 40) + F.col("_row")
    return rows.join(files, "_file").withColumns({"event_id": number, "arrival_us": number}).drop(
        "_file", "_row", "_rank")


def read_meta_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Stored meta-alerts; start and end are parsed, unreadable ones become null."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    df = spark.read.schema(schema).option("header", True).csv(path)
    stamps = {c: F.try_to_timestamp(F.col(c)) for c in ("start_time", "end_time") if c in columns}
    return df.withColumns(stamps)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def filter_feed(alerts: DataFrame, agents: list[str] | None = None, min_level: int = 0) -> DataFrame:
    """Agent list and minimum level; both reach the scan as pushed filters."""
    out = alerts
    if agents:
        out = out.where(F.col("agent_name").isin(agents))
    if min_level > 0:
        out = out.where(F.col("rule_level") >= min_level)
    return out


def alert_stream(
    spark: SparkSession, path: str, schema: T.StructType, agents: list[str] | None = None, min_level: int = 0,
    files_per_trigger: int = 100,
) -> DataFrame:
    """Alerts arriving as Parquet files, oldest first, a bounded number per micro-batch."""
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return filter_feed(feed, agents, min_level)
