"""SQL building blocks of the independent checks: common table expressions over the given tables."""

import re

NAMES = "['soc-1','pusatkarir','dfir-iris','siput','proxy-manager','e-kuesioner','sads','DVWA']"
BASE = 1704067200000000
MIN = 60000000
KEY = "agent_id, rule_groups"


def _alerts(divide: int) -> str:
    return f"""(
  SELECT e.*,
    CASE WHEN srcip = '' THEN 'none' WHEN srcip LIKE '10.%' OR srcip LIKE '192.168.%' THEN 'internal'
         ELSE 'external' END AS srcip_type,
    CASE WHEN mitre_tactic = '' THEN 0 ELSE 1 END AS has_mitre,
    CASE WHEN mitre_tactic LIKE 'Execution%' THEN 1 ELSE 0 END AS has_critical_mitre,
    CASE agent_name WHEN 'dfir-iris' THEN 4 WHEN 'pusatkarir' THEN 3 WHEN 'proxy-manager' THEN 3 WHEN 'sads' THEN 3
         WHEN 'siput' THEN 2 WHEN 'e-kuesioner' THEN 2 ELSE 1 END AS criticality_score
  FROM (
    SELECT event_id, {BASE} + off_us AS ts_us,
      off_us + (event_id * 7919) % 97 * CASE WHEN event_id % 50 = 0 THEN 4000000 ELSE 50000 END AS arrival_us,
      'evt-' || event_id AS wazuh_alert_id,
      lpad(CAST(user_id % 8 + 1 AS VARCHAR), 3, '0') AS agent_id,
      {NAMES}[CAST(user_id % 8 + 1 AS INTEGER)] AS agent_name,
      CASE event_type WHEN 'error' THEN 'authentication_failed' WHEN 'click' THEN 'web' WHEN 'view' THEN 'syslog'
           WHEN 'purchase' THEN 'syscheck_file' ELSE 'sudo' END AS rule_groups,
      least(15, CAST(floor(value / 20) AS INTEGER)) AS rule_level,
      CAST(1000 + event_id % 7 AS INTEGER) AS rule_id,
      CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '10.0.0.' || (user_id % 25)
           WHEN 2 THEN '192.168.1.' || (user_id % 25) ELSE '203.0.113.' || (user_id % 25) END AS srcip,
      CASE WHEN event_id % 11 = 0 THEN 'Execution|Persistence' WHEN event_id % 7 = 0 THEN 'Discovery'
           ELSE '' END AS mitre_tactic,
      CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS is_synthetic,
      CASE WHEN event_id % 97 = 0 THEN 'A' ELSE '' END AS scenario_id
    FROM (SELECT *, (epoch_us(ts) - {BASE}) // {divide} AS off_us FROM events)
  ) e)"""


def _in_order(source: str, gap_min: int, key: str = KEY) -> str:
    """Rows in time order with their gap session."""
    w = f"(PARTITION BY {key} ORDER BY ts_us, event_id)"
    return f"""(
  SELECT *, min(ts_us) OVER (PARTITION BY {key}, sess) AS bstart, CAST(NULL AS BIGINT) AS parent FROM (
    SELECT *, sum(CASE WHEN before IS NULL OR ts_us - before > {gap_min * MIN} THEN 1 ELSE 0 END) OVER {w} AS sess FROM (
      SELECT *, lag(ts_us) OVER {w} AS before, row_number() OVER {w} AS n FROM {source})))"""


def _walk(source: str, order: str, gap: str, cap_min: int, key: str = KEY) -> tuple[str, str]:
    """Row-by-row recursion over every key: numbered rows, and the bucket each row falls into."""
    rows = f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM {source})"
    on = " AND ".join(f"r.{k} = w.{k}" for k in key.replace(" ", "").split(","))
    near, short = f"r.ts_us - w.bend <= {gap}", f"r.ts_us - w.bstart <= {cap_min * MIN}"
    rkey = ", ".join(f"r.{k}" for k in key.replace(" ", "").split(","))
    step = f"""(
  SELECT {key}, n, ts_us AS bstart, ts_us AS bend, CAST(NULL AS BIGINT) AS parent FROM %s WHERE n = 1
  UNION ALL
  SELECT {rkey}, r.n,
    CASE WHEN {near} AND {short} THEN w.bstart ELSE r.ts_us END,
    CASE WHEN {near} AND {short} THEN greatest(w.bend, r.ts_us) ELSE r.ts_us END,
    CASE WHEN {near} AND {short} THEN w.parent WHEN {near} THEN w.bstart END
  FROM %s w JOIN %s r ON {on} AND r.n = w.n + 1)"""
    return rows, step


RELEASE = "eff_us, eff_seq, late, seq"

CTE: dict[str, str] = {
    "alerts": _alerts(60),
    "day_alerts": _alerts(1),
    "dup_alerts": """(
  SELECT * FROM alerts UNION ALL
  SELECT * REPLACE (arrival_us + 600000000 AS arrival_us) FROM alerts WHERE event_id % 10 = 0)""",
    # The k-th largest (time, arrival) pair among all earlier arrivals decides who was overtaken.
    "ordered": """(
  SELECT *, CASE WHEN overtaken THEN kth.t ELSE ts_us END AS eff_us, CASE WHEN overtaken THEN kth.s ELSE seq END AS eff_seq,
    CASE WHEN overtaken THEN 1 ELSE 0 END AS late FROM (
    SELECT *, coalesce(ts_us < kth.t OR (ts_us = kth.t AND seq < kth.s), false) AS overtaken FROM (
      SELECT *, top[50] AS kth FROM (
        SELECT *, max({'t': ts_us, 's': seq}, 50) OVER (
          ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
          SELECT *, row_number() OVER (ORDER BY arrival_us, event_id) - 1 AS seq FROM alerts)))))""",
    "classified": """(
  SELECT *, CASE WHEN eff_us - ts_us <= 60000000 THEN 'on_time' WHEN eff_us - ts_us <= 120000000 THEN 'late_ok'
    ELSE 'late_drop' END AS lateness FROM ordered)""",
    "kept": "(SELECT * FROM classified WHERE lateness <> 'late_drop')",
    "m_fold": _in_order("alerts", 5),
    "m_day": _in_order("day_alerts", 15),
    "m_t1": f"""(
  SELECT *, first_value(ts_us) OVER (PARTITION BY {KEY}, sess ORDER BY {RELEASE}) AS bstart,
    CAST(NULL AS BIGINT) AS parent, row_number() OVER (PARTITION BY {KEY} ORDER BY {RELEASE}) AS n FROM (
    SELECT *, sum(CASE WHEN before IS NULL OR ts_us - before > {5 * MIN} THEN 1 ELSE 0 END) OVER (
      PARTITION BY {KEY} ORDER BY {RELEASE} ROWS UNBOUNDED PRECEDING) AS sess FROM (
      SELECT *, max(ts_us) OVER (PARTITION BY {KEY} ORDER BY {RELEASE}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kept)))""",
    "cap_rows": _walk("kept", RELEASE, str(15 * MIN), 60)[0],
    "cap_walk": _walk("kept", RELEASE, str(15 * MIN), 60)[1] % ("cap_rows", "cap_walk", "cap_rows"),
    "m_cap": f"(SELECT r.*, w.bstart, w.parent FROM cap_rows r JOIN cap_walk w USING ({KEY}, n))",
}


# The adaptive gap, one positive gap between processed alerts after the other.
START = 15 * MIN
CTE.update({
    "kept_seq": f"""(
  SELECT *, count(*) FILTER (step > 0) OVER (ORDER BY {RELEASE} ROWS UNBOUNDED PRECEDING) AS gap_no FROM (
    SELECT *, ts_us - lag(ts_us) OVER (ORDER BY {RELEASE}) AS step FROM kept))""",
    "gap_lists": """(
  SELECT list(step / 1000000::DOUBLE ORDER BY gap_no) AS v, count(*) AS n,
    avg(step / 1000000::DOUBLE) FILTER (gap_no <= 100) AS mean FROM kept_seq WHERE step > 0)""",
    "gap_walk": f"""(
  SELECT 100 AS gap_no, mean AS pace, {START}::DOUBLE AS cur FROM gap_lists WHERE n >= 100
  UNION ALL
  SELECT gap_no, pace, CASE WHEN mean / pace >= 3 THEN greatest(0.8::DOUBLE * cur, {0.5 * START}::DOUBLE)
    WHEN mean / pace <= 0.33::DOUBLE THEN least(1.2::DOUBLE * cur, {1.5 * START}::DOUBLE) ELSE cur END
  FROM (SELECT w.gap_no + 1 AS gap_no, 0.1::DOUBLE * v[w.gap_no + 1] + 0.9::DOUBLE * w.pace AS pace, cur, mean
    FROM gap_walk w, gap_lists WHERE w.gap_no < n))""",
    "adapted": f"""(
  SELECT k.*, CAST(round(coalesce(cur, {START})) AS BIGINT) AS cur_dt_us FROM kept_seq k LEFT JOIN gap_walk USING (gap_no))""",
    "adapt_rows": _walk("adapted", RELEASE, "r.cur_dt_us", 60)[0],
    "adapt_walk": _walk("adapted", RELEASE, "r.cur_dt_us", 60)[1] % ("adapt_rows", "adapt_walk", "adapt_rows"),
    "m_adapt": f"(SELECT r.*, w.bstart, w.parent FROM adapt_rows r JOIN adapt_walk w USING ({KEY}, n))",
})


def _metas(members: str) -> str:
    tail = f"{KEY}, bstart"
    dist = lambda col: f"""(
    SELECT {tail}, '{{' || string_agg('"' || v || '":' || c, ',' ORDER BY v) || '}}' AS dist, max(c) AS top, count(*) AS k
    FROM (SELECT {tail}, CAST({col} AS VARCHAR) AS v, count(*) AS c FROM {members} GROUP BY ALL) GROUP BY {tail})"""
    return f"""(
  SELECT {KEY.replace(', ', " || '|' || ")} || '|' || bstart AS meta_id,
    CASE WHEN parent IS NOT NULL THEN {KEY.replace(', ', " || '|' || ")} || '|' || parent END AS parent_meta_id,
    c.*, greatest(0, (end_us - bstart) // 1000000) AS duration_sec,
    bstart AS start_us,
    CASE rule_groups WHEN 'syslog' THEN 1 WHEN 'sudo' THEN 2 WHEN 'syscheck_file' THEN 3 ELSE 4 END AS rule_group_severity_enc,
    (bstart // 3600000000) % 24 AS hour_of_day,
    r.k AS unique_rules_triggered, r.top AS top_rule_count, r.dist AS rule_id_dist, l.dist AS severity_dist,
    '{{"' || rule_groups || '":' || alert_count || '}}' AS rule_group_dist
  FROM (
    SELECT {tail}, max(parent) AS parent, arg_min(agent_name, n) AS agent_name, max(ts_us) AS end_us,
      count(*) AS alert_count, max(rule_level) AS max_severity, sum(rule_level) AS severity_sum,
      count(DISTINCT nullif(srcip, '')) AS attacker_count,
      coalesce(array_to_string(list_sort(list(DISTINCT srcip) FILTER (srcip <> '')), '|'), '') AS attacker_ips,
      arg_min(criticality_score, n) AS agent_criticality, sum(has_mitre) AS mitre_hit_count,
      count(*) FILTER (srcip_type = 'external') AS external_threat_count,
      count(*) FILTER (srcip_type = 'internal') AS internal_src_count,
      max(is_synthetic) AS ground_truth, max(scenario_id) AS scenario_id
    FROM {members} GROUP BY {tail}) c
  JOIN {dist('rule_id')} r USING ({tail}) JOIN {dist('rule_level')} l USING ({tail}))"""


FEATURES_SQL = """(
  SELECT *, round(ln(1 + alert_count), 4) AS alert_count_log,
    round(alert_count / greatest(duration_sec, 1)::DOUBLE, 4) AS alert_velocity,
    round(top_rule_count / alert_count::DOUBLE, 4) AS rule_concentration,
    round(greatest(max_severity - severity_sum / alert_count::DOUBLE, 0), 4) AS severity_spread,
    round(coalesce(CASE WHEN base > 0 THEN greatest(least((alert_count - base) / base, 5), -5) END, 0), 4)
      AS deviation_from_baseline
  FROM (SELECT *, avg(alert_count) OVER (PARTITION BY agent_name ORDER BY start_us // 1000000
      RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS base FROM %s))"""

FEATURES = [
    "alert_count_log", "max_severity", "duration_sec", "rule_group_severity_enc", "agent_criticality", "hour_of_day",
    "alert_velocity", "mitre_hit_count", "rule_concentration", "severity_spread", "deviation_from_baseline",
]

CTE.update({
    "metas": _metas("m_fold"),
    "metas_day": _metas("m_day"),
    "metas_t1": _metas("m_t1"),
    "metas_cap": _metas("m_cap"),
    "metas_adapt": _metas("m_adapt"),
    "feats": FEATURES_SQL % "metas",
    "feats_day": FEATURES_SQL % "metas_day",
    "flong": "(" + " UNION ALL ".join(
        f"SELECT meta_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feats" for f in FEATURES) + ")",
    "raw_scored": "(SELECT *, ((alert_count * 37 + max_severity * 101) % 1000) / 1000.0::DOUBLE AS score FROM feats)",
    "theta": """(SELECT round(least(quantile_cont(score, 0.75) + 1.5 * (quantile_cont(score, 0.75)
      - quantile_cont(score, 0.25)), 1.0), 4) AS theta FROM raw_scored)""",
    # The fixture's scores rarely pass their own fence, so decisions are checked at a fixed threshold.
    "scored": """(
  SELECT *, CASE WHEN decision IN ('CRITICAL', 'SUSPICIOUS') THEN 'ESCALATE' WHEN decision = 'NOISE_HIGH'
      THEN 'DAILY_DIGEST' ELSE 'SUPPRESS' END AS action,
    CASE WHEN decision IN ('CRITICAL', 'SUSPICIOUS') THEN 1 ELSE 0 END AS escalate, round(score, 4) AS anomaly_score
  FROM (SELECT *, CASE WHEN score >= 0.4 THEN CASE
      WHEN max_severity < 7 AND alert_count < 5 AND mitre_hit_count = 0 THEN 'CONTEXTUAL_ANOMALY'
      WHEN max_severity >= 7 THEN 'CRITICAL' ELSE 'SUSPICIOUS' END
    WHEN max_severity >= 7 THEN 'NOISE_HIGH' ELSE 'NOISE' END AS decision FROM raw_scored))""",
    "fixed": f"""(
  SELECT *, ts_us // {15 * MIN} * {15 * MIN} AS wstart FROM alerts)""",
    "fixed_metas": "(SELECT agent_id, rule_groups, wstart, count(*) AS alert_count FROM fixed GROUP BY ALL)",
    "per_group": """(
  SELECT g.rule_groups AS rule_group, n_raw, n_meta_session, n_meta_fixed,
    round((1 - n_meta_session / n_raw::DOUBLE) * 100, 2) AS arr_session_pct,
    round((1 - n_meta_fixed / n_raw::DOUBLE) * 100, 2) AS arr_fixed_pct,
    round((1 - n_meta_session / n_raw::DOUBLE) * 100 - (1 - n_meta_fixed / n_raw::DOUBLE) * 100, 2) AS delta_arr
  FROM (SELECT rule_groups, count(*) AS n_raw FROM alerts GROUP BY ALL) g
  JOIN (SELECT rule_groups, count(*) AS n_meta_session FROM metas GROUP BY ALL) USING (rule_groups)
  JOIN (SELECT rule_groups, count(*) AS n_meta_fixed FROM fixed_metas GROUP BY ALL) USING (rule_groups))""",
    "local": """(
  SELECT *, CAST(lt AS DATE) AS local_date, hour(lt) AS local_hour, isodow(lt) - 1 AS day_of_week,
    strftime(lt, '%Y-%m') AS month, CAST(date_trunc('week', lt) AS DATE) AS week_start
  FROM (SELECT *, make_timestamp(ts_us) + INTERVAL 8 HOUR AS lt FROM day_alerts))""",
    "gaps": "(SELECT g AS gap_us FROM (SELECT ts_us - lag(ts_us) OVER (ORDER BY ts_us) AS g FROM day_alerts) WHERE g > 0)",
    "bursts": """(
  SELECT min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_alerts,
    round((max(ts_us) - min(ts_us)) / 1000000::DOUBLE, 6) AS duration_sec, count(DISTINCT agent_name) AS agents,
    count(DISTINCT rule_groups) AS groups, max(rule_level) AS max_level
  FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts_us - p > 60000000 THEN 1 ELSE 0 END) OVER (ORDER BY ts_us, event_id) AS b
    FROM (SELECT *, lag(ts_us) OVER (ORDER BY ts_us, event_id) AS p FROM day_alerts)) GROUP BY b)""",
    "sweep_rows": "(SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY delta_t_min, agent_id, rule_groups ORDER BY "
                  + RELEASE + ") AS n FROM (SELECT *, 0 AS n, unnest([1,5,10,15,20,30,45,60]) AS delta_t_min FROM kept))",
    "sweep_walk": _walk("", RELEASE, "(w.delta_t_min::BIGINT * 60000000)", 60, "delta_t_min, agent_id, rule_groups")[1]
    % ("sweep_rows", "sweep_walk", "sweep_rows"),
    "sweep": """(
  SELECT delta_t_min, n_raw, n_meta, round((1 - n_meta / n_raw::DOUBLE) * 100, 2) AS arr_pct
  FROM (SELECT delta_t_min, count(DISTINCT (agent_id, rule_groups, bstart)) AS n_meta FROM sweep_walk GROUP BY ALL),
    (SELECT count(*) AS n_raw FROM alerts))""",
    "span": "(SELECT min(ts_us) AS lo_us, max(ts_us) AS hi_us, count(*) AS n_alerts FROM alerts)",
    "agent_pool": "(SELECT row_number() OVER (ORDER BY agent_id, agent_name) - 1 AS a, * FROM (SELECT DISTINCT agent_id, agent_name FROM alerts))",
    "group_pool": "(SELECT row_number() OVER (ORDER BY rule_groups) - 1 AS g, * FROM (SELECT DISTINCT rule_groups FROM alerts))",
})


P = 2147483647


def _draw(multiplier: int) -> str:
    multiple = f"((noise_no + 1) * {multiplier} % {P})"
    return f"({multiple} * {multiple} % {P})"


def noise(rate: str, ids: str) -> str:
    """Noise rows for the rate expression ``rate``; ``ids`` yields ``noise_no`` and, if needed, the rate."""
    return f"""(
  SELECT i.*, lo_us + (hi_us - lo_us) // {P} * {_draw(16807)} + (hi_us - lo_us) % {P} * {_draw(16807)} // {P} AS ts_us,
    agent_id, agent_name, rule_groups,
    CAST({_draw(66911)} % 4 + 1 AS INTEGER) AS rule_level, CAST(1000 + {_draw(85931)} % 9000 AS INTEGER) AS rule_id
  FROM {ids} i CROSS JOIN span
  JOIN agent_pool ON a = {_draw(48271)} % (SELECT count(*) FROM agent_pool)
  JOIN group_pool ON g = {_draw(69621)} % (SELECT count(*) FROM group_pool))"""


CTE.update({
    "noise10": noise("0.1", "(SELECT unnest(range(0, (SELECT n_alerts * 10 // 100 FROM span))) AS noise_no)"),
    "noise_all": noise("", """(SELECT pct / 100.0::DOUBLE AS noise_rate, unnest(range(0, n_alerts * pct // 100)) AS noise_no
      FROM span, (SELECT unnest([5, 10, 20, 30]) AS pct))"""),
    "mix": """(
  SELECT noise_rate, agent_id, rule_groups, ts_us, -1 - noise_no AS event_id, 1 AS is_noise FROM noise_all UNION ALL
  SELECT r, agent_id, rule_groups, ts_us, event_id, 0
  FROM alerts, (SELECT unnest([0.05, 0.1, 0.2, 0.3])::DOUBLE AS r))""",
    "mix_rows": "(SELECT *, row_number() OVER (PARTITION BY noise_rate, agent_id, rule_groups ORDER BY ts_us, event_id) AS n FROM mix)",
    "mix_walk": _walk("", "", str(15 * MIN), 60, "noise_rate, agent_id, rule_groups")[1] % ("mix_rows", "mix_walk", "mix_rows"),
    "robust": """(
  SELECT noise_rate, count(*) AS n_meta, sum(noise) AS n_noise,
    sum(CASE WHEN noise > 0 AND noise < n THEN noise ELSE 0 END) AS noise_absorbed
  FROM (
    SELECT noise_rate, agent_id, rule_groups, bstart, count(*) AS n, sum(is_noise) AS noise
    FROM mix_rows JOIN mix_walk USING (noise_rate, agent_id, rule_groups, n) GROUP BY ALL
    UNION ALL
    SELECT 0.0::DOUBLE, agent_id, rule_groups, bstart, count(*), 0 FROM m_cap GROUP BY ALL)
  GROUP BY noise_rate)""",
})

# Capped buckets of alerts in time order, with the number of their key's later buckets.
CTE.update({
    "time_rows": f"(SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ts_us, event_id) AS n FROM alerts)",
    "time_walk": _walk("", "", str(15 * MIN), 60)[1] % ("time_rows", "time_walk", "time_rows"),
    "time_buckets": f"""(
  SELECT *, max(start_us) OVER (PARTITION BY {KEY}) AS last_start FROM (
    SELECT {KEY}, bstart AS start_us, parent AS parent_start_us, max(ts_us) AS end_us, count(*) AS alert_count,
      max(rule_level) AS max_severity, sum(has_mitre) AS mitre_hit_count
    FROM time_rows JOIN time_walk USING ({KEY}, n) GROUP BY ALL))""",
})

_ORDER = list(CTE)


def _needed(text: str, found: set[str]) -> set[str]:

    for name in CTE:
        if name not in found and re.search(rf"\b{name}\b", text):
            found.add(name)
            _needed(CTE[name], found)
    return found


def query(body: str, spec: dict[str, str]) -> str:
    """``body`` with the table expressions it uses and the output columns cast to their declared types."""
    needed = _needed(body, set())
    # Table expressions are declared in dependency order; ``local`` etc. only refer to earlier ones.
    done: list[str] = []

    def add(name: str) -> None:
        for dep in _needed(CTE[name], set()) - {name}:
            if dep not in done:
                add(dep)
        if name not in done:
            done.append(name)

    for name in _ORDER:
        if name in needed:
            add(name)
    heads = ",\n".join(f"{name} AS {CTE[name]}" for name in done)
    with_ = f"WITH RECURSIVE {heads}\n" if done else ""
    cols = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in spec.items())
    return f"{with_}SELECT {cols} FROM (\n{body}\n) AS result"
