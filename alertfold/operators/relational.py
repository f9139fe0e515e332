"""Dedup, union, order, sampling and lookups on alert tables."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def dedup_alerts(df: DataFrame, alert_id: str = "wazuh_alert_id", order: tuple[str, ...] = ("arrival_us", "event_id")) -> DataFrame:
    """First arrival of every alert id; alerts without an id are all kept.

    ``min_by`` combines before the shuffle, so an id repeated in a large share of all rows does not gather anywhere.
    """
    has_id = F.coalesce(F.col(alert_id), F.lit("")) != ""
    whole = F.struct(*df.columns)
    first = df.where(has_id).groupBy(alert_id).agg(F.min_by(whole, F.struct(*order)).alias("_row"))
    kept = first.select("_row.*")
    return kept.unionByName(df.where(~has_id))


def merge_batches(batches: list[DataFrame], time: str = "timestamp", **dedup) -> DataFrame:
    """Concatenate, dedup across batches and sort by time."""
    merged = batches[0]
    for other in batches[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return sort_time(dedup_alerts(merged, **dedup), time)


def union_injected(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real and synthetic rows; columns that one side lacks are null there, except the two label columns."""
    out = real.unionByName(synthetic, allowMissingColumns=True)
    return out.withColumns({
        "is_synthetic": F.coalesce("is_synthetic", F.lit(0)), "scenario_id": F.coalesce("scenario_id", F.lit(""))})


def sort_time(df: DataFrame, time: str = "timestamp", tie: str = "event_id") -> DataFrame:
    return df.orderBy(time, tie)


def top_k(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Most frequent key combinations; ties by key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *keys).limit(k)


def top_share(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, everything else as ``others``, each with its share."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    head = counts.orderBy(F.desc("n"), key).limit(k)
    marked = counts.join(F.broadcast(head.select(key, F.lit(1).alias("_in"))), key, "left")
    label = F.when(F.col("_in") == 1, F.col(key)).otherwise("others")
    return marked.groupBy(label.alias("value")).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select(
        "value", "n", F.round(F.col("n") / F.col("total") * 100, 4).alias("pct"))


def label_join(scored: DataFrame, labels: DataFrame, key: str = "meta_id") -> DataFrame:
    """Attach ground truth; rows without a label are negative."""
    base = scored.drop("ground_truth")
    return base.join(labels.select(key, "ground_truth"), key, "left").withColumn(
        "ground_truth", F.coalesce("ground_truth", F.lit(0)))


def set_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    l, r = left.select(*on).distinct(), right.select(*on).distinct()
    return l.join(r, on, "left_anti").withColumn("side", F.lit("left")).unionByName(
        r.join(l, on, "left_anti").withColumn("side", F.lit("right")))


def missing_dates(df: DataFrame, date: str = "local_date") -> DataFrame:
    """Calendar days between the first and last day that hold no row."""
    days = df.select(date).distinct()
    span = days.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi")).alias(date))
    return every.join(days, date, "left_anti")


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "event_id", draw: Column | None = None) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of a unique key: exact size, independent of partitioning.

    ``draw`` takes the place of the hash; it should spread over the whole range of a long. A cut-off on the hash, taken from a count per hash prefix, replaces a global sort: only the rows of the prefix that
    holds the cut-off are ordered.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)) if draw is None else draw)
    hashed = hashed.withColumn("_p", F.shiftright("_h", 44))
    sizes = hashed.groupBy("_p").agg(F.count("*").alias("c"))
    cut = sizes.withColumn("before", F.sum("c").over(Window.orderBy("_p")) - F.col("c"))
    cut = cut.where((F.col("before") < n)).agg(F.max("_p").alias("_last"), F.max("before").alias("_before"))
    marked = hashed.crossJoin(F.broadcast(cut)).where(F.col("_p") <= F.col("_last"))
    whole = marked.where(F.col("_p") < F.col("_last"))
    edge = marked.where(F.col("_p") == F.col("_last"))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)))
    edge = edge.where(F.col("_r") <= n - F.col("_before")).drop("_r")
    return whole.unionByName(edge).select(*df.columns)
