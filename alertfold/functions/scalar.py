"""Column expressions over alert fields; all run inside whole-stage codegen."""

from pyspark.sql import Column, functions as F

from alertfold import schema as S


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def iso_utc(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def primary_group(groups: Column) -> Column:
    """Heaviest element of a group list; the earliest wins a tie, an empty list gives ``unknown``."""
    weights = literal_map(S.GROUP_PICK_WEIGHT)
    ranked = F.transform(
        groups,
        lambda g, i: F.struct(F.coalesce(weights[g], F.lit(0)).alias("w"), (-i).alias("i"), g.alias("g")),
    )
    return F.coalesce(F.array_max(ranked)["g"], F.lit("unknown"))


def srcip_type(ip: Column) -> Column:
    internal = F.lit(False)
    for prefix in S.INTERNAL_PREFIXES:
        internal = internal | ip.startswith(prefix)
    return (
        F.when(ip.isNull() | (ip == ""), "none")
        .when(internal, "internal")
        .otherwise("external")
    )


def criticality_label(agent_name: Column) -> Column:
    return F.coalesce(literal_map(S.AGENT_LABELS)[agent_name], F.lit("unknown"))


def criticality_of_label(label: Column) -> Column:
    return F.coalesce(literal_map(S.LABEL_SCORES)[F.lower(label)], F.lit(1))


def agent_score_by_name(agent_name: Column) -> Column:
    scores = {name.lower(): S.LABEL_SCORES[label] for name, label in S.AGENT_LABELS.items()}
    return F.coalesce(literal_map(scores)[F.lower(F.trim(agent_name))], F.lit(1))


def agent_criticality(score: Column, agent_name: Column) -> Column:
    """An explicit score wins; the default score 1 is looked up again by agent name."""
    return F.when(score != 1, score).otherwise(agent_score_by_name(agent_name))


def has_tactic(tactics: Column) -> Column:
    return F.when(F.size(F.coalesce(tactics, F.array().cast("array<string>"))) > 0, 1).otherwise(0)


def has_critical_tactic(tactics: Column) -> Column:
    critical = F.array(*[F.lit(t) for t in S.CRITICAL_TACTICS])
    return F.when(F.arrays_overlap(F.coalesce(tactics, F.array().cast("array<string>")), critical), 1).otherwise(0)


def pad_agent_id(agent_id: Column) -> Column:
    """Zero-fill to three characters; longer ids stay whole (``lpad`` alone would cut them)."""
    return F.when(F.length(agent_id) < 3, F.lpad(agent_id, 3, "0")).otherwise(agent_id)


def group_key(rule_groups: Column) -> Column:
    return F.lower(F.trim(rule_groups))


def group_severity_code(rule_groups: Column) -> Column:
    codes = literal_map(S.GROUP_SEVERITY_CODE)
    return F.coalesce(codes[group_key(rule_groups)], F.lit(S.DEFAULT_GROUP_CODE))


def group_is_mapped(rule_groups: Column) -> Column:
    return literal_map(S.GROUP_SEVERITY_CODE)[group_key(rule_groups)].isNotNull()


def _up_to(level: Column, labels: dict[int, str], above: str) -> Column:
    found = F.lit(above)
    for limit in sorted(labels, reverse=True):
        found = F.when(level <= limit, labels[limit]).otherwise(found)
    return F.when(level.isNull(), above).otherwise(found)


def severity_bucket(level: Column) -> Column:
    return _up_to(level, S.SEVERITY_BUCKETS, S.SEVERITY_ABOVE)


def severity_zone(level: Column) -> Column:
    return _up_to(level, S.SEVERITY_ZONES, S.ZONE_ABOVE)


def subnet24(ip: Column) -> Column:
    return F.regexp_extract(ip, r"^(\d+\.\d+\.\d+)\.\d+$", 1)


def local_calendar(ts: Column, zone: str = S.REFERENCE_ZONE) -> dict[str, Column]:
    """Calendar fields of an instant in ``zone``; Monday is day 0."""
    local = F.from_utc_timestamp(ts, zone)
    return {
        "local_date": F.to_date(local),
        "local_hour": F.hour(local),
        "day_of_week": F.weekday(local),
        "month": F.date_format(local, "yyyy-MM"),
        "week_start": F.to_date(F.date_trunc("week", local)),
    }


def numeric_or(value: Column, default, kind: str = "double") -> Column:
    """Lenient number: text that is no number, and null, become ``default``."""
    return F.coalesce(value.try_cast("double").try_cast(kind), F.lit(default).cast(kind))


def reduction_rate(n_out: Column, n_in: Column) -> Column:
    """Share of rows folded away, in percent; 0 when there was no input."""
    return F.when(n_in > 0, (F.lit(1.0) - n_out / n_in) * 100.0).otherwise(F.lit(0.0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def json_counts(entries: Column) -> Column:
    """Render sorted ``array<struct<v,n>>`` as a JSON object of counts."""
    pairs = F.transform(entries, lambda e: F.struct(e["v"].cast("string").alias("key"), e["n"].alias("value")))
    return F.to_json(F.map_from_entries(pairs))
