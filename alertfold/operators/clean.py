"""Cleaning of stored alert rows. Each step is a function, :func:`clean_alerts` chains them."""

from pyspark.sql import DataFrame, functions as F

from alertfold import schema as S
from alertfold.functions import scalar as X


def select_rename(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project stored columns to canonical names; ``timestamp_utc`` must exist, others may be absent."""
    if "timestamp_utc" not in df.columns:
        raise KeyError("column timestamp_utc is required")
    mapping = {**S.REQUIRED_COLUMNS, **S.OPTIONAL_COLUMNS}
    cols = [F.col(k).alias(v) for k, v in mapping.items() if k in df.columns]
    return df.select(*[c for c in keep if c in df.columns], *cols)


def drop_corrupt(df: DataFrame) -> DataFrame:
    """Rows whose agent id is a spilled hash column, or neither a number nor a known agent."""
    if "agent_id" not in df.columns:
        return df
    text = F.lower(F.trim(F.coalesce(F.col("agent_id").cast("string"), F.lit("nan"))))
    known = [name.lower() for name in S.AGENT_IDS] + ["unknown", "nan"]
    numeric = F.col("agent_id").cast("string").try_cast("double").isNotNull()
    return df.where(~text.isin(S.HASH_TOKENS) & (numeric | text.isin(known)))


def parse_timestamp(df: DataFrame) -> DataFrame:
    """UTC instant; unreadable values become null."""
    if dict(df.dtypes)["timestamp"] == "timestamp":
        return df
    return df.withColumn("timestamp", F.try_to_timestamp("timestamp"))


def drop_bad_timestamps(df: DataFrame) -> DataFrame:
    return parse_timestamp(df).where(F.col("timestamp").isNotNull())


def clean_level(df: DataFrame) -> DataFrame:
    if "rule_level" not in df.columns:
        return df
    level = X.numeric_or(F.col("rule_level"), 0, "int")
    return df.withColumn("rule_level", F.when(level.between(0, 15), level).otherwise(0))


def clean_identity(df: DataFrame) -> DataFrame:
    """Defaults of source address, its type, agent id and rule id, also for absent columns."""
    has = set(df.columns)
    ip = F.trim(F.coalesce(F.col("srcip"), F.lit(""))) if "srcip" in has else F.lit("")
    return df.withColumns({
        "srcip": F.when(ip == "nan", "").otherwise(ip),
        "srcip_type": F.coalesce(F.col("srcip_type"), F.lit("none")) if "srcip_type" in has else F.lit("none"),
        "agent_id": F.trim(F.coalesce(F.col("agent_id"), F.lit("unknown"))) if "agent_id" in has else F.lit("unknown"),
        "rule_id": X.numeric_or(F.col("rule_id"), 0, "int") if "rule_id" in has else F.lit(0),
    })


def clean_criticality(df: DataFrame) -> DataFrame:
    if "criticality_score" in df.columns:
        score = F.least(F.greatest(X.numeric_or(F.col("criticality_score"), 1, "int"), F.lit(1)), F.lit(4))
    elif "agent_criticality_label" in df.columns:
        score = X.criticality_of_label(F.col("agent_criticality_label"))
    else:
        score = F.lit(1)
    return df.withColumn("criticality_score", score)


def clean_mitre_flags(df: DataFrame) -> DataFrame:
    flag = lambda c: F.least(F.greatest(X.numeric_or(F.col(c), 0, "int"), F.lit(0)), F.lit(1))
    return df.withColumns({
        c: flag(c) if c in df.columns else F.lit(0) for c in ("has_mitre", "has_critical_mitre")})


def clean_groups(df: DataFrame) -> DataFrame:
    group = F.coalesce(F.col("rule_groups"), F.lit("unknown")) if "rule_groups" in df.columns else F.lit("unknown")
    return df.withColumn("rule_groups", F.lower(F.trim(group)))


def clean_labels(df: DataFrame) -> DataFrame:
    """Label columns survive cleaning, so that injected data is cleaned like any other."""
    cols = {}
    if "is_synthetic" in df.columns:
        cols["is_synthetic"] = X.numeric_or(F.col("is_synthetic"), 0, "int")
    if "scenario_id" in df.columns:
        cols["scenario_id"] = F.coalesce("scenario_id", F.lit(""))
    return df.withColumns(cols) if cols else df


def clean_alerts(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows to canonical alerts: one scan, no shuffle."""
    out = select_rename(drop_corrupt(df), keep)
    for step in (drop_bad_timestamps, clean_level, clean_identity, clean_criticality, clean_mitre_flags, clean_groups,
                 clean_labels):
        out = out.transform(step)
    missing = {"timestamp", "agent_id", "agent_name", "rule_groups", "rule_level"} - set(out.columns)
    if missing:
        raise KeyError(f"critical columns are missing: {sorted(missing)}")
    return out


def clean_report(df: DataFrame) -> DataFrame:
    """One row: rows in, rows dropped as corrupt, rows dropped for their timestamp, rows kept."""
    renamed = F.try_to_timestamp(F.col("timestamp_utc").cast("string")).isNotNull()
    text = F.lower(F.trim(F.coalesce(F.col("agent_id"), F.lit("nan"))))
    known = [name.lower() for name in S.AGENT_IDS] + ["unknown", "nan"]
    sound = ~text.isin(S.HASH_TOKENS) & (F.col("agent_id").try_cast("double").isNotNull() | text.isin(known))
    sound = F.coalesce(sound, F.lit(False))
    return df.agg(
        F.count("*").alias("n_in"), F.count(F.when(~sound, 1)).alias("n_corrupt"),
        F.count(F.when(sound & ~renamed, 1)).alias("n_bad_timestamp"), F.count(F.when(sound & renamed, 1)).alias("n_kept"))
