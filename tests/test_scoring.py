"""Forest, features, decisions and score metrics on small frames."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertfold.operators import decide as M, evaluate as E, features as FT, forest, relational as I
from alertfold.plans.flagship import score_metas

FEATURES = ["a", "b", "c"]


def cloud(spark, n=600, partitions=3):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    x[:5] += 12
    pdf = pd.DataFrame(x, columns=FEATURES).assign(meta_id=[f"m{i:04d}" for i in range(n)])
    return spark.createDataFrame(pdf).repartition(partitions)


@pytest.mark.parametrize("trees,subsample", [(40, 64), (8, 32)])
def test_forest_ranks_planted_outliers_first(spark, trees, subsample):
    df = cloud(spark)
    nodes, size = forest.fit(df, FEATURES, trees, subsample)
    scored = M.normalize_scores(forest.score(df, nodes, size, FEATURES))
    top = [r.meta_id for r in scored.orderBy(F.desc("score")).limit(5).collect()]
    assert sorted(top) == [f"m{i:04d}" for i in range(5)]
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_forest_does_not_depend_on_partitioning(spark):
    a, _ = forest.fit(cloud(spark, partitions=1), FEATURES, 8, 32)
    b, _ = forest.fit(cloud(spark, partitions=7), FEATURES, 8, 32)
    pick = lambda d: {tuple(r) for r in d.collect()}
    assert pick(a) == pick(b)
    assert all(r.size >= 1 and r.depth <= 5 for r in a.collect())


def test_equal_scores_become_one_half(spark):
    df = spark.range(5).select(F.lit(-0.4).alias("raw_score"))
    assert {r.score for r in M.normalize_scores(df).collect()} == {0.5}


def test_seeded_sample_is_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("event_id"))
    for n in (0, 1, 777, 5000, 9000):
        a = {r.event_id for r in I.seeded_sample(df.repartition(2), n, 7).collect()}
        assert len(a) == min(n, 5000)
        assert a == {r.event_id for r in I.seeded_sample(df.repartition(9), n, 7).collect()}


def test_baseline_deviation_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"m{i}", rng.choice(["x", "y"]), rng.randrange(0, 5 * 86_400) * 1_000_000 + rng.randrange(1_000_000),
             rng.randrange(1, 50)) for i in range(400)]
    rows += [("p", "x", 200_000 * 1_000_000, 7), ("q", "x", (200_000 - 86_400) * 1_000_000, 9), ("r", "x", 200_000_900_000, 3)]
    df = spark.createDataFrame(rows, "meta_id string, agent_name string, start_us long, alert_count long")
    got = {r.meta_id: r.deviation_from_baseline for r in FT.deviation_from_baseline(df).collect()}
    for meta, agent, start, n in rows:
        s = start // 1_000_000
        base = [c for _, a, t, c in rows if a == agent and s - 86_400 <= t // 1_000_000 < s]
        mean = sum(base) / len(base) if base else 0
        want = max(-5.0, min(5.0, (n - mean) / mean)) if mean > 0 else 0.0
        assert got[meta] == pytest.approx(want, abs=6e-5)


def test_stored_distributions(spark):
    df = spark.createDataFrame([('{"1":3,"2":1}',), ("",), ("{oops",), (None,)], "j string")
    out = df.select(FT.concentration_of(F.col("j")).alias("c"), FT.spread_of(F.lit(5), F.col("j")).alias("s")).collect()
    assert [r.c for r in out] == [0.75, 1.0, 1.0, 1.0]
    assert [r.s for r in out] == [3.75, 5.0, 5.0, 5.0]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0.3, 0, 1), (0.9, 0, 0)], "anomaly_score double, ground_truth int, escalate int")
    assert E.pr_auc(df).first().pr_auc is None
    assert E.fbeta(df).first().f1 is None
    assert E.false_negative_rate(df).first().fnr is None
    assert E.fpr_sweep(df).count() == 0


def test_average_precision_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1)]
    df = spark.createDataFrame(rows, "anomaly_score double, ground_truth int")
    assert E.pr_auc(df).first().pr_auc == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5, abs=1e-4)


def test_elbow_rules(spark):
    def at(ys):
        xs = [1, 5, 10, 15, 20][: len(ys)]
        df = spark.createDataFrame(list(zip(xs, map(float, ys))), "delta_t_min int, arr_pct double")
        return E.elbow(df).first().delta_t_min
    assert at([10.0, 20.0]) == 1
    assert at([30, 60, 61, 70, 71]) == 10      # largest second difference
    assert at([10, 40, 60, 70, 75]) == 10      # concave: farthest from the diagonal


def test_score_metas_end_to_end(spark):
    rng = random.Random(1)
    rows = [(f"m{i}", f"a{i % 3}", "web", i * 60_000_000, rng.randrange(1, 9), rng.randrange(0, 12), rng.randrange(0, 3),
             30, '{"1":2}', '{"3":2}') for i in range(300)]
    rows[7] = ("m7", "a1", "attack", 7 * 60_000_000, 5000, 15, 900, 3000, '{"1":2}', '{"3":2}')
    metas = spark.createDataFrame(
        rows, "meta_id string, agent_name string, rule_groups string, start_us long, alert_count long, max_severity int, "
              "mitre_hit_count long, duration_sec long, rule_id_dist string, severity_dist string")
    out = {r.meta_id: r for r in score_metas(metas, trees=40, subsample=64).collect()}
    assert len(out) == 300 and out["m7"].anomaly_score == 1.0 and out["m7"].decision == "CRITICAL"


def test_projection_matches_a_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 4)) @ np.diag([5.0, 2.0, 0.5, 0.1]) @ np.linalg.qr(rng.standard_normal((4, 4)))[0]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(str(k), *map(float, row)) for k, row in enumerate(x)], "meta_id string, a double, b double, c double, d double")
    placed, shares = forest.pca_2d(df, names)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(shares, (s ** 2 / (s ** 2).sum())[:2])
    rows = sorted(placed.collect(), key=lambda r: int(r.meta_id))
    for k, got in enumerate((np.array([r.pc1 for r in rows]), np.array([r.pc2 for r in rows]))):
        want = x @ vt[k]
        assert np.allclose(got, want) or np.allclose(got, -want)
