"""Sessions as they stood at many moments, without a row per alert and moment.

A group holds the alerts of one key that any of its triggers can see, in time order. Triggers are taken in arrival order and
make their alerts visible as they pass. What a session counts are sums over a stretch of visible alerts: they come from sums
kept per 32 alerts, per 32 of those and so on, so a trigger costs a few short additions however many alerts it sees.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FAN = 32  # alerts, or sums of one level, that one sum of the next level stands for
DENSE = 512  # distinct values of a group up to which sums are kept; beyond that a trigger counts the alerts it sees
TOGETHER = 4096  # sessions whose counts are held at a time
KINDS = ("rule_level", "rule_id", "srcip", "mitre", "srcip_type", "synthetic", "scenario")
FOLDED = (
    "alert_count long, lo_us long, end_us long, first struct<first_by: long, txt: string, score: int>, max_severity int, "
    "severity_sum long, mitre_hit_count long, external_threat_count long, internal_src_count long, "
    "unique_rules_triggered long, top_rule_count long, rule_entries array<struct<v: string, n: long>>, "
    "level_entries array<struct<v: string, n: long>>, ground_truth int, scenario_id string, ips array<string>")
_ENTRIES = pa.list_(pa.struct([("v", pa.string()), ("n", pa.int64())]))
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "entries": _ENTRIES, "ips": pa.list_(pa.string()),
    "first": pa.struct([("first_by", pa.int64()), ("txt", pa.string()), ("score", pa.int32())])}
COLUMNS = pa.schema([(name, _TYPES[kind]) for name, kind in (
    ("trigger_seq", "long"), ("alert_count", "long"), ("lo_us", "long"), ("end_us", "long"), ("first", "first"),
    ("max_severity", "int"), ("severity_sum", "long"), ("mitre_hit_count", "long"), ("external_threat_count", "long"),
    ("internal_src_count", "long"), ("unique_rules_triggered", "long"), ("top_rule_count", "long"),
    ("rule_entries", "entries"), ("level_entries", "entries"), ("ground_truth", "int"), ("scenario_id", "string"),
    ("ips", "ips"))])


class _Values:
    """The distinct values of every kind, numbered through: kind ``k`` has the numbers from ``start[k]`` on, in the order of
    their text, nulls first. ``codes`` holds the numbers of every row."""

    def __init__(self, rows: pa.Table):
        self.of, self.start, codes, at = {}, {}, [], 0
        for kind in KINDS:
            coded = rows.column(kind).combine_chunks().dictionary_encode(null_encoding="encode")
            values = coded.dictionary.to_pylist()
            order = sorted(range(len(values)), key=lambda k: (values[k] is not None, str(values[k])))
            place = np.empty(len(values), np.int64)
            place[order] = np.arange(len(values))
            codes.append(place[coded.indices.to_numpy(zero_copy_only=False)] + at)
            self.of[kind], self.start[kind] = [values[k] for k in order], at
            at += len(values)
        self.n, self.codes = at, np.stack(codes, axis=1)


class _Visible:
    """Which rows are visible, and how often each value occurs in a stretch of visible rows."""

    def __init__(self, codes: np.ndarray, n_values: int):
        self.codes, self.n_values, self.mask = codes, n_values, np.zeros(len(codes), bool)
        self.sums, size = [], len(codes)
        while n_values <= DENSE and size > FAN:
            size = -(-size // FAN)
            self.sums.append(np.zeros((size, n_values), np.int32))

    def show(self, rows: np.ndarray) -> None:
        self.mask[rows] = True
        for level, sums in enumerate(self.sums, 1):
            np.add.at(sums, ((rows // FAN ** level)[:, None], self.codes[rows]), 1)

    def first(self, begin: int, end: int) -> int:
        """The first visible row from ``begin`` up to ``end``, -1 for none."""
        part = self.mask[begin:end]
        at = int(part.argmax()) if len(part) else 0
        return begin + at if len(part) and part[at] else -1

    def last(self, begin: int, end: int) -> int:
        return end - 1 - int(self.mask[begin:end][::-1].argmax())

    def _rows(self, begin: int, end: int) -> np.ndarray:
        return np.bincount(self.codes[begin:end][self.mask[begin:end]].ravel(), minlength=self.n_values)

    def counts(self, begin: int, end: int) -> np.ndarray:
        if not self.sums or end - begin <= 2 * FAN:
            return self._rows(begin, end)
        low, high = -(-begin // FAN), end // FAN
        out = self._rows(begin, low * FAN) + self._rows(high * FAN, end)
        for level, sums in enumerate(self.sums):
            begin, end = low, high
            if level + 1 == len(self.sums) or end - begin <= 2 * FAN:
                return out + sums[begin:end].sum(0)
            low, high = -(-begin // FAN), end // FAN
            out += sums[begin:low * FAN].sum(0) + sums[high * FAN:end].sum(0)
        return out


def _lists(counts: np.ndarray, values: list, as_entry: bool) -> pa.Array:
    """Per row the values that occur, with their counts or (nulls left out) without."""
    names = pa.array([None if v is None else str(v) for v in values], pa.string())
    row, col = np.nonzero(counts)
    offsets = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)), pa.int32())
    flat = names.take(pa.array(col))
    if as_entry:
        flat = pa.StructArray.from_arrays([flat, pa.array(counts[row, col], pa.int64())], ["v", "n"])
    return pa.ListArray.from_arrays(offsets, flat)


def _measures(rows: pa.Table, values: _Values, counts: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
    """The columns of ``FOLDED`` for sessions with these value counts, first and last rows."""
    part = lambda kind: counts[:, values.start[kind]:values.start[kind] + len(values.of[kind])]

    def total(kind: str) -> pa.Array:  # sums leave nulls out, and are null where nothing else is there
        here = np.array([v is not None for v in values.of[kind]])
        sums = part(kind) @ np.array([v or 0 for v in values.of[kind]], np.int64)
        return pa.array(sums, pa.int64(), mask=part(kind)[:, here].sum(1) == 0)

    def best(kind: str, pick, type_: pa.DataType) -> pa.Array:
        named = [(v, k) for k, v in enumerate(values.of[kind]) if v is not None]
        named.sort(reverse=pick is max)
        there = part(kind)[:, [k for _, k in named]] > 0
        if not named:
            return pa.nulls(len(counts), type_)
        at = there.argmax(1)
        return pa.array([v for v, _ in named], type_).take(pa.array(at, mask=~there[np.arange(len(at)), at]))

    def named(kind: str, value) -> pa.Array:
        k = values.of[kind].index(value) if value in values.of[kind] else None
        return pa.array(np.zeros(len(counts), np.int64) if k is None else part(kind)[:, k], pa.int64())

    of_first, ts = pa.array(first), rows.column("ts_us").to_numpy()
    address = [k for k, v in enumerate(values.of["srcip"]) if v]
    start = pa.StructArray.from_arrays([
        pa.array(ts[first], pa.int64()), rows.column("agent_name").combine_chunks().take(of_first),
        rows.column("criticality_score").combine_chunks().take(of_first)], ["first_by", "txt", "score"])
    return [
        pa.array(part("rule_level").sum(1), pa.int64()), pa.array(ts[first], pa.int64()), pa.array(ts[last], pa.int64()), start,
        best("rule_level", max, pa.int32()), total("rule_level"), total("mitre"), named("srcip_type", "external"),
        named("srcip_type", "internal"), pa.array((part("rule_id") > 0).sum(1), pa.int64()),
        pa.array(part("rule_id").max(1), pa.int64()), _lists(part("rule_id"), values.of["rule_id"], True),
        _lists(part("rule_level"), values.of["rule_level"], True), best("synthetic", max, pa.int32()),
        best("scenario", min, pa.string()), _lists(part("srcip")[:, address], [values.of["srcip"][k] for k in address], False)]


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows by time, agent name and score, nulls first."""
    order = pc.sort_indices(rows, sort_keys=[("ts_us", "ascending"), ("agent_name", "ascending"),
                                                     ("criticality_score", "ascending")], null_placement="at_start")
    return rows.take(order)


def sessions_at(rows: pa.Table, triggers: pa.Table, span_us: int, gap_us: int) -> pa.Table:
    """For every trigger (``trigger_seq``, ``now_us``, and ``times``, how often it counts) the sessions over the rows with at
    most its ``seq`` and at least the time ``now_us - span_us``: trigger_seq and the columns of ``FOLDED``."""
    if not rows.num_rows or not triggers.num_rows:
        return COLUMNS.empty_table()
    rows = _in_order(rows)
    ts, seq = rows.column("ts_us").to_numpy(), rows.column("seq").to_numpy()
    values = _Values(rows)
    visible = _Visible(values.codes, values.n)
    triggers = triggers.sort_by("trigger_seq")
    moments = [triggers.column(c).to_numpy() for c in ("trigger_seq", "now_us", "times")]
    by_seq = np.argsort(seq, kind="stable")
    shown_to = np.searchsorted(seq[by_seq], moments[0], "right")
    begins = np.searchsorted(ts, moments[1] - span_us)
    cell = ts // gap_us  # rows of one gap-wide cell are never apart by more than the gap
    edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(ts)).tolist()
    out, found, counts, shown = [], [], [], 0

    def table() -> pa.Table:
        trigger, first, last = (np.array(x) for x in zip(*found))
        columns = _measures(rows, values, np.array(counts), first, last)
        return pa.table([pa.array(trigger, pa.int64()), *columns], schema=COLUMNS)

    for trigger, to, begin, times in zip(moments[0].tolist(), shown_to.tolist(), begins.tolist(), moments[2].tolist()):
        if to > shown:
            visible.show(by_seq[shown:to])
            shown = to
        sessions: list[list[int]] = []
        for low, high in zip(edges, edges[1:]):
            if high <= begin or (first := visible.first(max(low, begin), high)) < 0:
                continue
            last = visible.last(first, high)
            if sessions and ts[first] - ts[sessions[-1][1]] <= gap_us:
                sessions[-1][1] = last
            else:
                sessions.append([first, last])
        for first, last in sessions:
            found.append((trigger, first, last))
            counts.append(visible.counts(first, last + 1) * times)
        if len(found) >= TOGETHER:
            out.append(table())
            found, counts = [], []
    if found:
        out.append(table())
    return pa.concat_tables(out) if out else COLUMNS.empty_table()
