"""Synthetic attacks, noise, label propagation and robustness to noise."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertfold import schema as S
from alertfold.functions import scalar as X
from alertfold.operators import sessions as A
from alertfold.operators.chains import chain_counts, chain_sums
from alertfold.operators.relational import union_injected
from alertfold.schema import MICROS, MINUTE_US


@dataclass(frozen=True)
class Phase:
    """A run of equal alerts from one agent at a fixed interval."""

    scenario: str
    agent: str
    group: str
    level: int
    rule_id: int
    has_mitre: int
    has_critical: int
    tactic: str
    srcip: str
    score: int
    n: int
    interval_s: int
    at: float  # share of the covered time at which the scenario starts
    delay_min: int = 0


# The attack templates.
BRUTE_FORCE = [
    Phase("A", "pusatkarir", "authentication_failed", 10, 5716, 0, 0, "", S.ATTACKER_IPS[0], 1, 50_000, 2, 0.3),
]
MULTI_STAGE = [
    Phase("B", "sads", "authentication_failed", 8, 5720, 1, 0, "Discovery", S.ATTACKER_IPS[1], 2, 2000, 4, 0.5, 0),
    Phase("B", "sads", "web", 11, 31101, 1, 1, "Initial Access", S.ATTACKER_IPS[1], 2, 1500, 6, 0.5, 5),
    Phase("B", "sads", "syscheck_file", 7, 553, 1, 1, "Persistence", S.ATTACKER_IPS[1], 2, 1000, 8, 0.5, 10),
]
LATERAL_ORDER = ["siput", "proxy-manager", "sads", "e-kuesioner", "DVWA", "dfir-iris", "pusatkarir", "soc-1"]
LATERAL = [
    Phase("C", agent, "authentication_failed", 10, 5763, 1, 0, "Lateral Movement", S.ATTACKER_IPS[2], 2, 50_000, 3,
          0.7, 15 * i)
    for i, agent in enumerate(LATERAL_ORDER)
]
DRAWS = 2_147_483_647  # a prime: squares of multiples of the row number modulo it are the draws of the noise rows
SCENARIOS = {"A": BRUTE_FORCE, "B": MULTI_STAGE, "C": LATERAL}


def time_span(alerts: DataFrame) -> DataFrame:
    """One row: first and last time and number of alerts."""
    ts = F.unix_micros("timestamp")
    return alerts.agg(F.min(ts).alias("lo_us"), F.max(ts).alias("hi_us"), F.count("*").alias("n_alerts"))


def millionths(share: float) -> int:
    """A share in whole parts per million, so that products with counts are exact in integer arithmetic."""
    return round(share * 1_000_000)


def _start(share: float) -> Column:
    """Whole second at a share of the covered time, in integer arithmetic."""
    at = F.expr(f"lo_us + cast(cast(hi_us - lo_us as decimal(20, 0)) * {millionths(share)} div 1000000 as bigint)")
    return F.floor(at / MICROS) * MICROS


def template_rows(alerts: DataFrame, scenario: str, scale: float = 1.0) -> DataFrame:
    """Alerts of one scenario, placed by the covered time of ``alerts``; ``scale`` shortens every phase."""
    spark = alerts.sparkSession
    span = time_span(alerts)
    out = None
    for no, p in enumerate(SCENARIOS[scenario]):
        rows = spark.range(max(1, int(p.n * scale))).crossJoin(F.broadcast(span))
        part = rows.select(
            F.timestamp_micros(
                _start(p.at) + F.lit(p.delay_min * MINUTE_US) + F.col("id") * (p.interval_s * MICROS)).alias("timestamp"),
            F.concat(F.lit(f"SYN-{p.scenario}-{no}-"), F.col("id").cast("string")).alias("wazuh_alert_id"),
            (F.lit(-((list(SCENARIOS).index(scenario) * 64 + no + 1) << 40)) - F.col("id")).alias("event_id"),
            F.lit(S.AGENT_IDS[p.agent]).alias("agent_id"), F.lit(p.agent).alias("agent_name"),
            F.lit(p.group).alias("rule_groups"), F.lit(p.level).alias("rule_level"), F.lit(p.rule_id).alias("rule_id"),
            F.lit(p.srcip).alias("srcip"), F.lit("external").alias("srcip_type"),
            F.lit(p.score).alias("criticality_score"), F.lit(p.has_mitre).alias("has_mitre"),
            F.lit(p.has_critical).alias("has_critical_mitre"), F.lit(p.tactic).alias("mitre_tactic"),
            F.lit(1).alias("is_synthetic"), F.lit(p.scenario).alias("scenario_id"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def inject(alerts: DataFrame, scenarios: tuple[str, ...] = ("A", "B", "C"), scale: float = 1.0) -> DataFrame:
    """Real alerts, marked as such, with the synthetic alerts of every scenario, as one data set in time order.

    Rows come in no particular order, but where the alerts have an arrival time it becomes that of the alert itself for
    all rows, so that the injection makes nothing late. Synthetic rows get ids below zero, unique over all scenarios.
    """
    marked = alerts.withColumns({"is_synthetic": F.lit(0), "scenario_id": F.lit("")})
    has_id = "event_id" in alerts.columns
    for scenario in scenarios:
        rows = template_rows(alerts, scenario, scale)
        marked = union_injected(marked, rows if has_id else rows.drop("event_id"))
    return marked.withColumn("arrival_us", F.unix_micros("timestamp")) if "arrival_us" in alerts.columns else marked


def propagate_labels(metas: DataFrame, mapped: DataFrame, labels: DataFrame, alert: str = "event_id") -> DataFrame:
    """A meta-alert is positive when any member is synthetic; the first scenario in name order is kept."""
    hits = labels.where(F.col("is_synthetic") == 1).select(alert, "scenario_id")
    found = mapped.join(hits, alert).groupBy(*A.KEYS, F.col("bucket_start_us").alias("start_us")).agg(
        F.min("scenario_id").alias("scenario_id"), F.lit(1).alias("ground_truth"))
    base = metas.drop("ground_truth", "scenario_id")
    return base.join(found, [*A.KEYS, "start_us"], "left").withColumns({
        "ground_truth": F.coalesce("ground_truth", F.lit(0)), "scenario_id": F.coalesce("scenario_id", F.lit(""))})


def noise_rows(alerts: DataFrame, rate: float, independent: bool = False) -> DataFrame:
    """``int(n * rate)`` low-severity alerts spread over the covered time.

    Times and picks follow from the row number, each by a draw of its own. Agent id and name are picked as a pair unless
    ``independent``.
    The pools are the distinct agents and groups of the data; they are looked up by rank through a join, so their size
    does not matter.
    """
    spark = alerts.sparkSession
    span = time_span(alerts)
    agents = _ranked(alerts.select("agent_id", "agent_name").distinct(), ["agent_id", "agent_name"], "a")
    groups = _ranked(alerts.select("rule_groups").distinct(), ["rule_groups"], "g")
    sizes = agents.agg(F.count("*").alias("n_a")).crossJoin(groups.agg(F.count("*").alias("n_g")))
    count = span.select(F.expr(f"n_alerts * {millionths(rate)} div 1000000")).first()[0]
    ids = spark.range(count).crossJoin(F.broadcast(span)).crossJoin(F.broadcast(sizes))
    multiple = lambda m: f"((id + 1) * {m} % {DRAWS})"
    draw = lambda m: f"({multiple(m)} * {multiple(m)} % {DRAWS})"
    offset = F.expr(f"(hi_us - lo_us) div {DRAWS} * {draw(16807)} + (hi_us - lo_us) % {DRAWS} * {draw(16807)} div {DRAWS}")
    rows = ids.select(
        F.col("id").alias("noise_no"), F.timestamp_micros(F.col("lo_us") + offset).alias("timestamp"),
        F.expr(f"{draw(48271)} % n_a").alias("a"), F.expr(f"{draw(39373)} % n_a").alias("a2"),
        F.expr(f"{draw(69621)} % n_g").alias("g"), F.expr(f"cast({draw(66911)} % 4 + 1 as int)").alias("rule_level"),
        F.expr(f"cast(1000 + {draw(85931)} % 9000 as int)").alias("rule_id"))
    names = agents.select(F.col("a").alias("a2" if independent else "a"), "agent_name")
    rows = rows.join(agents.select("a", "agent_id"), "a").join(names, "a2" if independent else "a").join(groups, "g")
    return rows.select(
        "noise_no", "timestamp", "agent_id", "agent_name", "rule_groups", "rule_level", "rule_id",
        F.lit("").alias("srcip"), F.lit("none").alias("srcip_type"), F.lit(1).alias("criticality_score"),
        F.lit(0).alias("has_mitre"), F.lit(0).alias("has_critical_mitre"), F.lit("").alias("mitre_tactic"),
        F.lit(0).alias("is_synthetic"), F.lit("").alias("scenario_id"), F.lit(1).alias("is_noise"))


def _ranked(pool: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct pool values numbered from 0 in value order."""
    return pool.withColumn(name, (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))


def with_noise(alerts: DataFrame, rate: float) -> DataFrame:
    """Alerts and noise; noise rows get ids below zero so that ids stay unique."""
    real = alerts.withColumn("is_noise", F.lit(0))
    if rate <= 0:
        return real
    noise = noise_rows(alerts, rate).withColumn("event_id", -1 - F.col("noise_no")).drop("noise_no")
    return real.unionByName(noise, allowMissingColumns=True)


def robustness_sweep(
    alerts: DataFrame, gap_minutes: int = 15, cap_minutes: int = 60, k: int = 50, lateness_sec: float = 60.0,
    rates: list[float] = S.NOISE_RATES,
) -> DataFrame:
    """Reduction, its loss against no noise, and how much noise falls into buckets with real alerts, per rate.

    Without noise the alerts are taken in arrival order; noisy mixtures are in time order, so that nothing is late.
    A noise row depends on its number only, so the noise of a rate is the head of the noise of a higher rate: each row has
    the smallest rate it belongs to as its level, rows of equal time and level are counted before the shuffle, and all noisy
    rates are counted in one sorted pass (``chains.chain_sums``).
    """
    slim = alerts.select("event_id", "arrival_us", "timestamp", "agent_id", "agent_name", "rule_groups")
    gap, cap = gap_minutes * MINUTE_US, cap_minutes * MINUTE_US
    quiet = chain_counts(A.newest_times(A.with_key(A.ordered_alerts(slim, k, lateness_sec))), A.KEYS, [gap], cap)
    none = F.lit(0).cast("long")
    per_rate = quiet.select(F.lit(0.0).alias("noise_rate"), F.col("n").alias("n_meta"), none.alias("n_noise"), none.alias("noise_absorbed"))
    noisy = sorted({float(r) for r in rates if r > 0})
    if noisy:
        n_alerts = slim.count()
        limits = [n_alerts * millionths(r) // 1_000_000 for r in noisy]
        mixed = with_noise(slim, noisy[-1])
        level = F.lit(len(noisy))
        for i, limit in reversed(list(enumerate(limits))):
            level = F.when(-F.col("event_id") <= limit, i).otherwise(level)
        level = F.when(F.col("is_noise") == 0, 0).otherwise(level)
        times = A.with_key(mixed).groupBy(*A.KEYS, F.unix_micros("timestamp").alias("t"), level.cast("long").alias("level")).agg(
            F.count("*").alias("n"), F.sum(F.col("is_noise").cast("long")).alias("noise"))
        sums = chain_sums(times, A.KEYS, [(gap, i) for i in range(len(noisy))], cap)
        of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("variant"))
        per_rate = per_rate.unionByName(sums.select(
            of(noisy, "double").alias("noise_rate"), F.col("n").alias("n_meta"), of(limits, "long").alias("n_noise"),
            F.col("absorbed").alias("noise_absorbed")))
    original = alerts.agg(F.count("*").alias("n_original"))
    rated = per_rate.crossJoin(F.broadcast(original)).withColumn(
        "arr", X.reduction_rate(F.col("n_meta"), F.col("n_original")))
    # One row per rate is left, so the rate without noise is looked up in a window over all of them.
    quiet_arr = F.max(F.when(F.col("noise_rate") == 0, F.col("arr"))).over(Window.partitionBy())
    return rated.withColumn("base_arr", quiet_arr).select(
        "noise_rate", "n_original", "n_noise", (F.col("n_original") + F.col("n_noise")).alias("n_total"), "n_meta",
        F.round("arr", 2).alias("arr_pct"), F.round(F.col("base_arr") - F.col("arr"), 2).alias("arr_degradation"),
        "noise_absorbed",
        F.round(X.ratio_or_zero(F.col("noise_absorbed") * 100.0, F.col("n_noise")), 2).alias("noise_absorption_rt"))
