"""The whole path from arriving alerts to decided meta-alerts."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertfold.operators import decide as M, features as FT, forest, sessions as A
from alertfold.plans import fixtures
from alertfold.session import pin_session


def score_metas(metas: DataFrame, trees: int = 200, subsample: int = 256, seed: int = 42, method: str = "iqr",
                override: float | None = None) -> DataFrame:
    """Features, isolation-forest scores, threshold and decisions of meta-alerts."""
    # Fitting, scoring, scaling and the threshold all read the meta-alerts: fold the raw alerts once.
    feats = FT.guard_types(FT.enrich(metas)).persist(StorageLevel.MEMORY_AND_DISK)
    scaled = M.robust_scale(feats.select("meta_id", *FT.FEATURES)).persist(StorageLevel.MEMORY_AND_DISK)
    nodes, size = forest.fit(scaled, trees=trees, subsample=subsample, seed=seed)
    scores = M.normalize_scores(forest.score(scaled, nodes, size)).select("meta_id", "score")
    joined = feats.join(scores, "meta_id")
    return M.decide(joined, M.threshold(scores, method=method, override=override))


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the capped meta-alerts of the ``events`` timeline, with a deterministic score."""
    alerts = fixtures.alerts(pin_session(spark), sf_dir)
    metas = FT.enrich(A.run_meta_alerts(alerts, gap_minutes=15, cap_minutes=60, k=50, lateness_sec=60))
    points = (F.col("alert_count") * 37 + F.col("max_severity") * 101) % 1000
    scored = metas.withColumn("score", points / F.lit(1000.0))
    return M.action_report(M.decide(scored, M.threshold(scored)))
