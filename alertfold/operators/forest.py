"""Isolation forest: trees are grown as separate tasks on small samples, rows are scored where they are.

What is gathered is bounded by the model, not by the data: ``trees x subsample`` rows for fitting and
``trees x (2 x subsample - 1)`` nodes for scoring.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from alertfold.operators.relational import seeded_sample
from alertfold.schema import FEATURES

EULER = 0.5772156649015329
NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, left int, right int, size int, depth int"

def path_bonus(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def tree_samples(df: DataFrame, features: list[str], trees: int, subsample: int, seed: int, key: str) -> tuple[DataFrame, int]:
    """Rows of every tree as ``(tree_id, key, features)`` and the number of rows per tree.

    One rule for tables of any size: a seeded pool of at most ``trees x subsample`` rows is put in a random order, and each
    tree takes the ``subsample`` rows that follow those of the tree before it, beginning anew at the end of the pool. From a
    full pool the trees draw without replacement.
    """
    slim = df.select(F.col(key).cast("string").alias("_key"), *[F.col(f).cast("double").alias(f) for f in features])
    pool = seeded_sample(slim, trees * subsample, seed, "_key")
    rank = F.row_number().over(Window.orderBy(F.xxhash64("_key", F.lit(seed)), "_key")) - 1  # over the bounded pool
    n = min(slim.count(), trees * subsample)
    size = min(subsample, n)
    # The trees' shares lie one after the other on the endless repetition of the pool; a row stands there every n places.
    places = F.sequence(rank.cast("long"), F.lit(max(trees * size - 1, 0)).cast("long"), F.lit(max(n, 1)).cast("long"))
    every = pool.withColumn("_places", F.when(rank < trees * size, places)).withColumn("_place", F.explode("_places"))
    return every.withColumn("tree_id", F.expr(f"cast(_place div {max(size, 1)} as int)")).drop("_places", "_place"), size


def fit(
    df: DataFrame, features: list[str] = FEATURES, trees: int = 200, subsample: int = 256, seed: int = 42,
    key: str = "meta_id",
) -> tuple[DataFrame, int]:
    """Node table of the forest and the subsample size. Equal data gives an equal forest under any partitioning."""
    samples, size = tree_samples(df, features, trees, subsample, seed, key)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        tree = int(pdf.tree_id.iloc[0])
        x = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = [[tree, 0, -1, 0.0, -1, -1, len(x), 0]]
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            at, rows = open_nodes.pop()
            depth = nodes[at][7]
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if len(rows) <= 1 or depth >= limit or len(usable) == 0:
                continue
            feature = int(rng.choice(usable))
            cut = rng.uniform(lo[feature], hi[feature])
            low = x[rows, feature] <= cut
            left, right = len(nodes), len(nodes) + 1
            nodes[at][2:6] = [feature, cut, left, right]
            for child, part in ((left, rows[low]), (right, rows[~low])):
                nodes.append([tree, child, -1, 0.0, -1, -1, len(part), depth + 1])
                open_nodes.append((child, part))
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return samples.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA), size


def score(df: DataFrame, nodes: DataFrame, size: int, features: list[str] = FEATURES, out: str = "raw_score") -> DataFrame:
    """Add ``-2^(-E[h]/c)``: the lower, the more anomalous."""
    table = nodes.orderBy("tree_id", "node_id").toPandas()  # trees x (2 x subsample - 1) rows at most
    forest = []
    for _, t in table.groupby("tree_id"):
        depth = t.depth.to_numpy() + path_bonus(t["size"].to_numpy())
        forest.append((t.feature.to_numpy(), t.threshold.to_numpy(), t.left.to_numpy(), t.right.to_numpy(), depth))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = max(float(path_bonus(np.array([size]))[0]), 1.0)

    @F.pandas_udf(T.DoubleType())
    def isolation(values: pd.DataFrame) -> pd.Series:
        x = values.to_numpy(dtype=float)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, depth in shared.value:
            node = np.zeros(len(x), dtype=np.int64)
            active = rows[feature[node] >= 0]
            while len(active):
                at = node[active]
                node[active] = np.where(x[active, feature[at]] <= cut[at], left[at], right[at])
                active = active[feature[node[active]] >= 0]
            total += depth[node]
        return pd.Series(-np.exp2(-total / len(shared.value) / scale))

    return df.withColumn(out, isolation(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))


def pca_2d(df: DataFrame, features: list[str] = FEATURES) -> tuple[DataFrame, list[float]]:
    """Two principal components of the (scaled) features and the share of variance each explains."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    model = PCA(k=2, inputCol="_x", outputCol="_pc").fit(vectors)
    pc = vector_to_array("_pc")
    out = model.transform(vectors).withColumns({"pc1": pc[0], "pc2": pc[1]}).drop("_x", "_pc")
    return out, [float(v) for v in model.explainedVariance.toArray()]
