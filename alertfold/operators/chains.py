"""Greedy chains over time: the next link is the first time that lies more than the cap after the last one.

A chain can't be cut anywhere, as each link depends on the one before. But a piece of it needs only its first link. So
the times of a group are cut into blocks of many caps; every block maps each time at which a chain may enter it to the
time at which that chain leaves it. These maps are composed in a tree of stored tables: upwards, neighbouring blocks make
one of twice the width, and only the entries near its start stay, so that each level holds half of the one below; downwards,
each block learns at which of them the one real chain comes in. Then every block walks its own piece.

Work is spread by (group, block): one group of any length uses as many tasks as it has blocks.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from alertfold.session import stored

BLOCK_CAPS = 1024  # caps per block, fewer where times are dense
TIMES_PER_BLOCK = 250_000
BEFORE, OWN, AFTER = -1, 0, 1  # times before a block that tell its first gap, its own, and those in which a chain may go on
NONE = -(1 << 62)


def _groups(batches, keys: list[str]):
    """(one-row record batch of the keys, arrays of the other columns) for each group of rows sorted by ``keys``."""
    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        first = pa.RecordBatch.from_arrays([c.slice(0, 1) for c in columns], names=keys)
        if held is not None and not held.equals(first):
            yield held, [np.concatenate(p) for p in zip(*parts)]
            held, parts = None, []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        rest = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in keys]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a and held is not None:
                yield held, [np.concatenate(p) for p in zip(*parts)]
                parts = []
            if a or held is None:
                held = pa.RecordBatch.from_arrays([c.slice(a, 1) for c in columns], names=keys)
            parts.append([c[a:b] for c in rest])
    if held is not None:
        yield held, [np.concatenate(p) for p in zip(*parts)]


def _rows(keys: list[str], found: list[tuple], names: list[str]) -> pa.RecordBatch:
    """One batch from (one-row key batch, arrays of equal length) pairs."""
    table = pa.Table.from_batches([head for head, _ in found])
    sizes = [len(columns[0]) for _, columns in found]
    table = table.take(pa.array(np.repeat(np.arange(len(found)), sizes)))
    values = [np.concatenate(c) for c in zip(*(columns for _, columns in found))]
    return pa.RecordBatch.from_arrays(
        [*[table.column(c).combine_chunks() for c in keys], *[pa.array(v, pa.int64()) for v in values]], names=[*keys, *names])


def _flow(groups, keys: list[str], names: list[str], at_once: int = 20_000):
    found, size = [], 0
    for head, columns in groups:
        if len(columns[0]):
            found.append((head, columns))
            size += len(columns[0])
        if size >= at_once:
            yield _rows(keys, found, names)
            found, size = [], 0
    if found:
        yield _rows(keys, found, names)


def block_map(own: np.ndarray, after: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a block's times: the next link (an index into both arrays joined), and where the chain leaves the block
    (``NONE``: it ends)."""
    both = np.concatenate([own, after])
    follows = np.searchsorted(both, own + cap, side="right")
    last = np.where(follows < len(own), follows, np.arange(len(own)))
    while True:  # pointer jumping, log2 of the links per block
        further = last[last]
        if (further == last).all():
            break
        last = further
    out = follows[last]
    return follows, np.where(out < len(both), np.append(both, NONE)[out], NONE)


def chain_starts(
    records: DataFrame, group: list[str], cap_us: int, longest_step_us: int, start: str = "session_start_us",
    time: str = "reach_us", block_caps: int = BLOCK_CAPS, times_per_block: int = TIMES_PER_BLOCK,
) -> DataFrame:
    """``group`` and ``bucket_start_us`` for every link of every group's chain.

    ``records`` holds the distinct times of each group; ``start`` names the group column with the group's first time, and
    neighbouring times of a group are at most ``longest_step_us`` apart. Keys must not be null.
    """
    records = stored(records.select(*group, F.col(time).alias("t")), "chain-times")
    since = F.col("t") - F.col(start)
    cells = records.groupBy(*group, F.floor(since / F.lit(cap_us)).alias("cell")).agg(F.count("*").alias("n"))
    shape = cells.agg(F.max("n").alias("dense"), F.max("cell").alias("longest")).first()
    jump = cap_us + longest_step_us
    caps = max(1, min(block_caps, times_per_block // max(shape["dense"] or 1, 1)))
    width = max(caps * cap_us, jump)
    n_blocks = (shape["longest"] or 0) * cap_us // width + 2
    block = F.floor(since / F.lit(width))
    keys = [*group, "block"]
    key_fields = [*[records.schema[c] for c in group], T.StructField("block", T.LongType())]
    # A block also sees what follows it within one jump: there its chains go on.
    placed = records.select("*", F.when((block > 0) & (since - block * width < jump), F.array(block, block - 1)).otherwise(
        F.array(block)).alias("blocks"), block.alias("home"))
    placed = placed.select(*group, F.explode("blocks").alias("block"), (F.col("block") < F.col("home")).cast("int").alias("side"), "t")
    sorted_blocks = lambda df, *then: df.repartition(*keys).sortWithinPartitions(*keys, *then)

    def first_walk(batches):
        """Links of the first block (to: ``NONE``) and, for all blocks, entries with the time at which their chain leaves."""
        def run(groups):
            for head, (side, t) in groups:
                own, after = t[side == OWN], t[side == AFTER]
                if not len(own):
                    continue
                follows, out = block_map(own, after, cap_us)
                origin = head.column(start)[0].as_py()
                number = head.column("block")[0].as_py()
                entries = np.flatnonzero((own - origin - number * width < jump) & (out != NONE))
                links = []
                if number == 0:
                    entries, i = entries[entries == 0], 0
                    while i < len(own):
                        links.append(i)
                        i = int(follows[i])
                yield head, [np.concatenate([own[links], own[entries]]), np.concatenate([np.full(len(links), NONE), out[entries]])]
        yield from _flow(run(_groups(batches, keys)), keys, ["at", "to"])

    longs = [T.StructField(c, T.LongType()) for c in ("at", "to")]
    first = stored(sorted_blocks(placed, "t").mapInArrow(first_walk, T.StructType([*key_fields, *longs])), "chain-maps")
    starts = first.where(F.col("to") == NONE).select(*group, F.col("at").alias("bucket_start_us"))
    if ((shape["longest"] or 0) + 1) * cap_us <= width:  # no group is longer than a block
        return starts
    real = _real_entries(first.where(F.col("to") != NONE).select(*group, "at", "to"), group, start, width, jump, n_blocks)

    def last_walk(batches):
        def run(groups):
            for head, (side, t) in groups:
                entry, own = t[side < 0], t[side == OWN]
                links, i = [], len(own)
                if len(entry):
                    i = int(np.searchsorted(own, entry[0]))
                while i < len(own):
                    links.append(i)
                    i = int(np.searchsorted(own, own[i] + cap_us, side="right"))
                yield head, [own[links]]
        yield from _flow(run(_groups(batches, keys)), keys, ["at"])

    entered = real.select(*group, F.floor((F.col("at") - F.col(start)) / F.lit(width)).alias("block"), F.lit(-1).alias("side"), F.col("at").alias("t"))
    later = placed.where((F.col("side") == OWN) & (F.col("block") > 0)).unionByName(entered.where("block > 0"))
    rest = sorted_blocks(later, "side", "t").mapInArrow(last_walk, T.StructType([*key_fields, longs[0]]))
    return starts.unionByName(rest.select(*group, F.col("at").alias("bucket_start_us")))


def _real_entries(maps: DataFrame, group: list[str], start: str, width: int, jump: int, n_blocks: int) -> DataFrame:
    """The time at which each group's own chain enters each of its blocks, from the blocks' entry maps (at, to).

    Upwards: a node of level l holds 2**l blocks, and keeps the entries within one jump of its start with the time at which
    their chains leave it. Downwards: a chain that enters a node enters its first child there or goes on to the second.
    """
    levels, span = [maps], width
    node = lambda t, wide: F.floor((F.col(t) - F.col(start)) / F.lit(wide))
    while span < n_blocks * width:
        span *= 2
        below = levels[-1]
        onward = below.select(*group, F.col("at").alias("to"), F.col("to").alias("far"))
        near = (F.col("at") - F.col(start)) - node("at", span) * span < jump
        met = below.where(near).join(onward, [*group, "to"], "left")
        stays = node("at", span) == node("to", span)
        levels.append(stored(met.where(~stays | F.col("far").isNotNull()).select(
            *group, "at", F.when(stays, F.col("far")).otherwise(F.col("to")).alias("to")), "chain-maps"))
    known = maps.where(F.col("at") == F.col(start)).select(*group, "at")
    for level in reversed(levels[:-1]):
        inner = known.join(level, [*group, "at"]).where(node("at", span) == node("to", span)).select(*group, F.col("to").alias("at"))
        known = stored(known.unionByName(inner), "chain-entries")
        span //= 2
    return known


# ---- many gaps, or many mixtures, at once ----------------------------------------------------------

COUNT, LEAVE, MAP = range(3)


def _piece(before: np.ndarray, both: np.ndarray, n_own: int, gap: int, cap: int, entry_until: int, weigh=None):
    """One block under one gap: links and weight of the chain that needs no entry, where it leaves (``NONE``: at a break, or
    not at all), and for each possible entry before the first break: entry, where its chain leaves, links, weight.

    ``both`` holds the block's ``n_own`` times and those after it; ``weigh(i, j)`` is the weight of links i whose buckets end
    before the places j.
    """
    steps = np.diff(both, prepend=before[-1] if len(before) else NONE)
    breaks = np.append(np.flatnonzero(steps > gap), len(both))
    head = min(int(breaks[0]), n_own)
    follows = np.searchsorted(both, both + cap, side="right")
    # A break ends the chain before it and starts another, so a chain goes on at the nearer of the two.
    next_break = breaks[np.searchsorted(breaks, np.arange(len(both)), side="right")] if len(both) else breaks[:0]
    onward = np.minimum(follows, next_break)
    weight = weigh(np.arange(len(both)), onward) if weigh else np.zeros(len(both), "int64")
    i, out, links, steps_on = head, NONE, [], onward.tolist()
    while i < n_own:
        links.append(i)
        i = steps_on[i]
    if links and i < len(both) and i != next_break[links[-1]]:
        out = int(both[i])
    # Before the first break: pointer jumping; ``size`` and ``sums`` cover the links up to ``last`` without it.
    last = np.where(onward[:head] < head, onward[:head], np.arange(head))
    size = (last != np.arange(head)).astype("int64")
    sums = weight[:head] * size
    while True:
        further = last[last]
        if (further == last).all():
            break
        size, sums, last = size + size[last], sums + sums[last], further
    if head < n_own or not head:
        leaves = np.full(head, NONE)
    else:
        at = onward[last]
        leaves = np.where((at < len(both)) & (at != next_break[last]), np.append(both, NONE)[np.minimum(at, len(both))], NONE)
    entries = np.flatnonzero(both[:head] < entry_until)
    return (len(links), int(weight[links].sum()), out, both[entries], leaves[entries], size[entries] + 1,
            (sums + weight[last])[entries])


def chain_counts(times: DataFrame, keys: list[str], gaps_us: list[int], cap_us: int | None, block_caps: int = BLOCK_CAPS,
                 times_per_block: int = TIMES_PER_BLOCK) -> DataFrame:
    """``gap_us, n``: how many sessions, split at the cap, the distinct times ``t`` of the keys form under each gap."""
    gaps = sorted(set(gaps_us))
    rows = times.select(*keys, "t", *[F.lit(v).cast("long").alias(c) for c, v in (("level", 0), ("n", 1), ("noise", 0))])
    found = chain_sums(rows, keys, [(g, 0) for g in gaps], cap_us, block_caps, times_per_block)
    return found.select(F.get(F.array(*map(F.lit, gaps)), F.col("variant")).cast("long").alias("gap_us"), "n")


def chain_sums(times: DataFrame, keys: list[str], variants: list[tuple[int, int]], cap_us: int | None,
               block_caps: int = BLOCK_CAPS, times_per_block: int = TIMES_PER_BLOCK) -> DataFrame:
    """``variant, n, absorbed`` for each variant (gap, level): sessions, split at the cap, of the rows of that level and below,
    and the ``noise`` in those of them that hold other rows as well. ``times`` has keys, t, level, n (rows) and noise.

    With the times of a key in order, a gap breaks them wherever neighbours are farther apart, and the rows of a level are a
    selection of them: all variants are read off one sorted pass, and no row is copied per variant. Without a cap that is a
    count of breaks. With one, a break also starts a chain anew, so only the piece of a block before its first break depends
    on the block before; those pieces are small maps as in :func:`chain_starts`, and only where whole blocks have no break
    are maps composed.
    """
    cap, longest = cap_us if cap_us is not None else (1 << 60), max(g for g, _ in variants)
    times = stored(times.select(*keys, "t", "level", "n", "noise"), "chain-times")
    unit = cap_us if cap_us is not None else longest
    cells = times.groupBy(*keys, F.floor(F.col("t") / F.lit(unit)).alias("cell")).agg(F.count("*").alias("n"))
    dense = cells.agg(F.max("n")).first()[0] or 1
    jump = unit + longest
    width = max(max(1, min(block_caps, times_per_block // dense)) * unit, jump)
    block = F.floor(F.col("t") / F.lit(width))
    offset = F.col("t") - block * width
    place = [*keys, "block"]
    placed = times.select(*keys, F.explode(F.concat(
        F.array(F.struct(block.alias("block"), F.lit(OWN).alias("side"))),
        F.when(offset < jump, F.array(F.struct((block - 1).alias("block"), F.lit(AFTER).alias("side")))).otherwise(F.array()),
        F.when(offset >= width - longest, F.array(F.struct((block + 1).alias("block"), F.lit(BEFORE).alias("side")))).otherwise(F.array()),
    )).alias("at"), "t", "level", "n", "noise").select(*keys, "at.block", "at.side", "t", "level", "n", "noise")

    def of_level(side, t, level, n, noise, most):
        """The rows of a level and below: times before the block, the block's and later ones without repeats, and sums."""
        rows = level <= most
        before, later = t[rows & (side == BEFORE)], rows & (side != BEFORE)
        t, side = t[later], side[later]
        first = np.flatnonzero(np.diff(t, prepend=NONE))
        add = lambda c: np.concatenate([[0], np.cumsum(np.add.reduceat(c[later], first) if len(first) else c[:0])])
        return before, t[first], int((side[first] == OWN).sum()), add(n), add(noise)

    def walk(batches):
        def run(groups):
            for head, columns in groups:
                if not (columns[0] == OWN).any():
                    continue
                until = head.column("block")[0].as_py() * width + jump
                rows, levels = [], {m: of_level(*columns, m) for m in {m for _, m in variants}}
                for v, (gap, most) in enumerate(variants):
                    before, both, n_own, all_rows, noise_rows = levels[most]

                    def absorbed(i, j):
                        noise = noise_rows[j] - noise_rows[i]
                        return np.where(noise < all_rows[j] - all_rows[i], noise, 0)

                    count, weight, out, entries, leaves, sizes, sums = _piece(before, both, n_own, gap, cap, until, absorbed)
                    rows.append(([v], [COUNT], [0], [0], [count], [weight]))
                    if out != NONE:
                        rows.append(([v], [LEAVE], [out], [0], [0], [0]))
                    rows.append((np.full(len(entries), v), np.full(len(entries), MAP), entries, leaves, sizes, sums))
                yield head, [np.concatenate(c).astype("int64") for c in zip(*rows)]
        yield from _flow(run(_groups(batches, place)), place, names)

    names = ["variant", "kind", "at", "to", "n", "absorbed"]
    fields = [*[times.schema[c] for c in keys], *[T.StructField(c, T.LongType()) for c in ("block", *names)]]
    found = stored(placed.repartition(*place).sortWithinPartitions(*place, "t").mapInArrow(walk, T.StructType(fields)), "chain-counts")
    group, sums = ["variant", *keys], ["variant", "n", "absorbed"]
    free = found.where(F.col("kind") == COUNT).select(*sums)
    known = found.where(F.col("kind") == LEAVE).select(*group, "at")
    maps = found.where(F.col("kind") == MAP).select(*group, "at", "to", "n", "absorbed")
    onward = maps.where(F.col("to") != NONE).select(*group, "at", "to")
    # Chains that cross blocks without a break: entries double the distance they reach with every round.
    while not onward.isEmpty():
        known = stored(known.unionByName(known.join(onward, [*group, "at"]).select(*group, F.col("to").alias("at"))).distinct(), "chain-entries")
        step = onward.select(*group, F.col("at").alias("to"), F.col("to").alias("far"))
        onward = stored(onward.join(step, [*group, "to"]).select(*group, "at", F.col("far").alias("to")), "chain-maps")
    entered = known.join(maps, [*group, "at"]).select(*sums)
    return free.unionByName(entered).groupBy("variant").agg(F.sum("n").alias("n"), F.sum("absorbed").alias("absorbed"))
