"""Near-duplicates, repeated passages, archives, vector search and the pipeline against brute force."""

import base64
import gzip
import hashlib
import json
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from alertfold.llm import multi_index, queries, quality, repeats, simhash, substrings, suffixes, warc
from alertfold.llm.common import new_folder, stored, table
from alertfold.llm.components import components
from tests.llm.conftest import awkward_texts


# --- SimHash

def plain_fingerprint(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """The component of each position, named by its smallest position."""
    values = np.array(prints, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(values))])
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates(awkward, nothing):
    rows = awkward_texts()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    label = plain_components(prints, 4)
    smallest = {c: min((i for (i, *_), k in zip(rows, label) if k == c and i is not None), default=None) for c in label}
    got = simhash.near_duplicates(awkward.drop("fp", "component_id")).collect()
    expected = sorted((str(i), p, str(smallest[c])) for (i, *_), p, c in zip(rows, prints, label))
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in got) == expected
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("tile", [7, 40, 1 << 16])
def test_tiles(spark, tile):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 64, 60, np.uint64)
    values = [int(seeds[k % 60]) for k in range(60)]
    for k in range(300):  # chains of few flipped bits
        value = values[rng.integers(len(values))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            value ^= 1 << int(b)
        values.append(value)
    values = sorted(set(values) | {0, (1 << 64) - 1, 1, 3})
    label = plain_components(values, 4)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(3)
    found = {r["node"]: r["root"] for r in components(simhash.links(frame, 4, tile)).collect()}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    groups = {}
    for v, c in zip(values, label):
        groups.setdefault(c, []).append(signed(v))
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_links_of_a_dense_cluster_are_a_forest(spark):
    values = [(1 << a) | (1 << b) for a in range(40) for b in range(a)]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    assert simhash.links(frame, 4, 100).count() < 40 * len(values)
    assert components(simhash.links(frame, 4)).select("root").distinct().count() == 1


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 70)] + [(500, 500 + k) for k in range(1, 200)] + [(900, 900), (-5, 70)]
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: -5 for k in range(71)} | {500 + k: 500 for k in range(1, 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_is_kept(awkward):
    rows = awkward_texts()
    label = plain_components([plain_fingerprint(t) for _, t, _ in rows], 4)
    kept = simhash.keep_one(awkward)
    got = Counter(r["doc_id"] for r in kept.collect())
    smallest = {c: min((i is None, i or 0) for (i, *_), k in zip(rows, label) if k == c) for c in set(label)}
    assert kept.columns == awkward.columns
    assert got == Counter(None if none else i for none, i in smallest.values())


def similar(a, b, size=5):
    one, two = ({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("tile, block", [(simhash.TILE, simhash.BLOCK), (7, 700)])
def test_near_copies_are_confirmed(spark, tile, block):
    """Groups by exact similarity, with edits of all strengths around the limit; distances reach well beyond 4 bits."""
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 200))]
        for edits in (0, 0, 1, 2, 3, 4, 5, 6, 8, 12):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(new))
    texts += ["one two", "One  two", "one three", "", "  "]
    lowered = [t.lower() for t in texts]
    prints = np.array([plain_fingerprint(t, 5) for t in texts], np.uint64)
    bits = np.bitwise_count(prints[:, None] ^ prints[None, :])
    near = np.array([[a.split() == b.split() or bool(a.split() and b.split()) and bits[i, j] <= 18 and similar(a, b) >= 0.8
                      for j, b in enumerate(lowered)] for i, a in enumerate(lowered)])
    assert (near & (bits > 4)).sum() > 20 and (~near & (bits <= 18)).sum() > 20
    label = np.arange(len(texts))
    for _ in texts:
        label = np.array([label[near[k]].min() for k in range(len(texts))])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = simhash.keep_one_similar(frame, tile=tile, block=block)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label.tolist()))
    assert simhash.keep_one_similar(frame.where("false")).count() == 0


def crowd(rng, size, edits):
    """Texts of one base text, each with ``edits`` words of its own: of any two, none reaches a similarity of 0.8 with many edits."""
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = []
    for _ in range(size):
        new = list(base)
        for at in rng.sample(range(len(new)), edits):
            new[at] = f"e{rng.randrange(10 ** 6)}"
        texts.append(" ".join(new))
    return texts


@pytest.mark.parametrize("edits", [1, 5])
def test_rows_of_a_crowd_grow_with_its_members(spark, edits):
    """Candidates and links of a crowd are at most one row per member, whether the members are near copies or not quite."""
    for size in (50, 200):
        texts = crowd(random.Random(size), size, edits)
        frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
        nodes = stored(simhash._nodes(frame.withColumn("order", F.struct("row")), "order", "text", 5), "nodes")
        pairs = stored(simhash._candidates(nodes, 18, 0.8, simhash.TILE), "pairs")
        assert size // 2 < pairs.count() < size
        linked = simhash._confirmed(
            nodes, components(pairs), frame.withColumnRenamed("row", "node"), 5, 18, 0.8, simhash.BLOCK)
        assert linked.count() == size - len(set(plain_near_copies(texts)))


def test_radius_reaches_near_copies():
    """Of pairs with a similarity of 0.8 to 0.85, at least 0.99 are within 18 bits, more than within 13, and all pass the sketch."""
    rng, within, far, alike = random.Random(5), 0, 0, 0
    tried = 0
    while tried < 400:
        a, b = crowd(rng, 2, 3)
        cut = rng.randrange(60, 150)
        a, b = (" ".join(t.split()[:cut]) for t in (a, b))
        if not 0.8 <= similar(a, b) <= 0.85:
            continue
        tried += 1
        bits = (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count()
        within, far = within + (bits <= 18), far + (bits <= 13)
        one, two = (np.frombuffer(simhash._sketch(simhash._shingles(t, 5, 42)[1]), np.uint32)[None] for t in (a, b))
        alike += bool(simhash._alike(one, two, np.array([simhash.SHARED]))[0])
    assert alike == tried and within >= 0.99 * tried and far < within


def test_pipeline_drops_copies_beyond_four_bits(spark):
    rng = random.Random(0)
    while True:
        base = [f"w{rng.randrange(900)}" for _ in range(100)]
        edited = list(base)
        for at in (20, 60):
            edited[at] = f"e{rng.randrange(900)}"
        a, b = " ".join(base), " ".join(edited)
        bits = [(plain_fingerprint(a, k) ^ plain_fingerprint(b, k)).bit_count() for k in (4, 5)]
        if bits[0] > 4 and bits[1] <= 13 and similar(a, b) >= 0.8:
            break
    frame = spark.createDataFrame([(1, a), (2, b), (3, "another text of some words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == [1, 3]


# --- repeated passages

def plain_cut(items, window):
    """A mask per sequence: what windows that start more than once cover."""
    seen = Counter(tuple(x[i:i + window]) for x in items for i in range(len(x) - window + 1))
    masks = []
    for x in items:
        mask = [False] * len(x)
        for i in range(len(x) - window + 1):
            if seen[tuple(x[i:i + window])] > 1:
                mask[i:i + window] = [True] * window
        masks.append(mask)
    return masks


def passages(rng, alphabet, n):
    """Texts cut from few passages with edits, so that matches begin and end everywhere."""
    base = ["".join(rng.choice(alphabet) for _ in range(1200)) for _ in range(3)]
    out = []
    for _ in range(n):
        source, a = rng.choice(base), rng.randrange(600)
        text = list(source[a:a + rng.randrange(100, 600)])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(alphabet)
        out.append("".join(text))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("window", [35, 22])
def test_repeated_words(spark, awkward, nothing, window):
    rng = random.Random(window)
    letters = passages(rng, "abcd", 60) + passages(rng, "ab", 10) + ["a" * 150, "ab" * 90]
    docs = [(k, " ".join(t)) for k, t in enumerate(letters)] + [(i, t) for i, t, _ in awkward_texts()]
    rows = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), window=window).collect()
    words = [(t or "").encode().split() for _, t in docs]
    expected = sorted((str(i), len(w), sum(m), b" ".join(x for x, y in zip(w, m) if not y).decode())
                      for (i, _), w, m in zip(docs, words, plain_cut(words, window)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in rows) == expected
    assert substrings.remove_repeats(awkward).count() == len(awkward_texts()) and substrings.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("crowd", [64, 3, 0])
def test_repeated_bytes(spark, awkward, nothing, crowd):
    rng = random.Random(crowd)
    docs = list(enumerate(passages(rng, "abcdefgh ", 60) + ["x" * 900, "xy" * 300 + "é" * 300, "é" * 350, "z" * 399, "w" * 400, "v" * 401]))
    docs += [(i, t if t is None else t[:3000]) for i, t, _ in awkward_texts()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = suffixes.remove_repeats(frame, window=400, crowd=crowd).collect()
    data = [(t or "").encode() for _, t in docs]
    expected = []
    for (i, _), x, m in zip(docs, data, plain_cut(data, 400)):
        expected.append((str(i), len(x), sum(m), sum(b and not a for a, b in zip([False, *m], m)), bytes(c for c, y in zip(x, m) if not y)))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == sorted(expected)
    assert suffixes.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("window", [272, 400])
def test_anchors_fill_all_hash_ranges_alike(window):
    rng = random.Random(window)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)).encode() for _ in range(200)]
    chunk = suffixes._anchored(window)(texts)
    sizes = [len(x) for x in repeats.request(0, chunk.keys, chunk.checks, chunk.many, 32).column("many").to_pylist()]
    assert len(sizes) == 32 and sum(sizes) == len(chunk.keys) > 1000
    assert max(sizes) < 2 * len(chunk.keys) / 32


def test_window_width_is_checked(awkward):
    with pytest.raises(ValueError):
        suffixes.remove_repeats(awkward, window=300)
    with pytest.raises(ValueError):
        substrings.remove_repeats(awkward, window=20)


@pytest.mark.parametrize("shallow", [0, 8, 48])
def test_deep_shallow_order(shallow):
    rng = random.Random(shallow)
    for _ in range(150):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = [base[:rng.randrange(60)] + bytes(rng.choice(b"abc\0") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 30))]
        assert [texts[k] for k in suffixes.deep_shallow(texts, 0, shallow)] == sorted(texts)


# --- archives

def plain_archive(pages, least=0):
    newest = {}
    for page, _, html in pages:
        payload = (html or "").encode()
        if len(payload) >= least and page is not None:
            newest[payload] = max(newest.get(payload, page), page)
    out = []
    for page, _, html in pages:
        payload = (html or "").encode()
        first = newest.get(payload)
        revisit = len(payload) >= least and first is not None and page != first
        out.append((str(page), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out)


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://b/\r\nX: y", ""), (5, "http://b", None),
         (6, "http://c", "é\r\n\r\nWARC/1.1\r\n" * 400), (6, "http://c", "other"), (7, "http://d", "tie"), (7, "http://d", "tie"),
         (None, "http://e", "tie"), (None, None, "lone"), (None, None, "lone")] + [(100 + k, "http://hot", "hot") for k in range(300)]


@pytest.mark.parametrize("least,roll", [(0, 1 << 20), (8, 700)])
def test_archive(spark, least, roll):
    rows = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, sha1 int").repartition(5)
    folder = warc.write(rows, new_folder(spark, "test-warc"), min_bytes=least, roll_bytes=roll)
    found = warc.read(spark, folder).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == plain_archive(PAGES, least)
    place = folder.removeprefix("file://").removeprefix("file:")
    manifest = json.load(open(f"{place}/{warc.MANIFEST}"))["files"]
    names = sorted(n for n in os.listdir(place) if n.endswith(".warc.gz"))
    assert [f["name"] for f in manifest] == names and "_temporary" not in os.listdir(place)
    assert sum(f["records"] for f in manifest) == len(PAGES)
    for f in manifest:
        data = open(f"{place}/{f['name']}", "rb").read()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    again = warc.write(rows.repartition(2), new_folder(spark, "test-warc"), min_bytes=least, roll_bytes=roll)
    body = lambda f: b"".join(open(f"{p}/{n}", "rb").read() for p in [f.removeprefix("file://").removeprefix("file:")] for n in sorted(os.listdir(p)) if n.endswith(".gz"))
    assert body(again) == body(folder)


def test_archive_of_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(empty, new_folder(spark, "test-warc"))).count() == 0


def test_damaged_payload_is_noticed(spark):
    folder = warc.write(spark.createDataFrame([(1, "http://a", "payload")], "page_id long, url string, html string"), new_folder(spark, "test-warc"))
    place = folder.removeprefix("file://").removeprefix("file:")
    name = next(f"{place}/{n}" for n in os.listdir(place) if n.endswith(".gz"))
    data = gzip.decompress(open(name, "rb").read()).replace(b"payload\r\n", b"pAyload\r\n")
    crc = f"{place}/.{os.path.basename(name)}.crc"
    assert not os.path.exists(crc)
    with open(name, "wb") as out:
        out.write(gzip.compress(data))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read(spark, folder).collect()


# --- vectors

def test_search_exact_on_all_cells(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, rng.standard_normal(9).round(2).tolist()) for k in range(1, 400)]
    vectors += [(k, [1.0] * 9) for k in range(400, 600)] + [(20, [1.0] * 9), (40, vectors[3][1])]
    bad = [(700, None), (720, [0.0] * 9), (740, [1.0, None] + [0.0] * 7), (760, [float("nan")] + [1.0] * 8), (780, [float("inf")] + [1.0] * 8), (800, [1.0]), (None, [1.0] * 9)]
    frame = spark.createDataFrame([(*v, "clash") for v in vectors + bad], "vec_id long, embedding array<double>, cell string").repartition(3)
    got = multi_index.search(frame, F.col("vec_id") % 20 == 0, k=5, centroids=4, share=1.0).collect()
    ids, matrix = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    answers = {}
    for r in got:
        answers.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(answers) == {int(i) for i in ids if i % 20 == 0}
    for q, found in answers.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        options = []
        for own in matrix[ids == q]:  # an id with two vectors asks with one of them
            score = (matrix * own).sum(1)
            order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
            options.append([(int(ids[k]), pytest.approx(score[k], abs=1e-12)) for k in order])
        assert [found[k] for k in range(1, 6)] in options


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = multi_index.search(frame, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(20, 1, 1), (20, 2, 40), (40, 1, 1), (40, 2, 20)]
    assert multi_index.search(frame.where("false"), F.lit(True)).count() == 0
    assert multi_index.search(frame.where("vec_id = 20"), F.lit(True)).count() == 0


def test_visits_pairs_in_order():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(6), rng.random(5), rng.integers(0, 3, (6, 5))
    cells = multi_index.visit(a, b, counts, 10 ** 6)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(counts.ravel()).tolist()
    few = multi_index.visit(a, b, counts, 7)
    assert few == cells[:len(few)] and counts.ravel()[few].sum() >= 7 > counts.ravel()[few[:-1]].sum()


def test_recall(spark, given):
    got = {}
    for r in queries.op6_inverted_multi_index(spark, given.replace("sf0.001", "sf0.01")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = table(spark, given.replace("sf0.001", "sf0.01"), "embeddings").collect()
    ids, matrix = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = total = 0
    for q, found in got.items():
        score = matrix @ matrix[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits, total = hits + len(best & found), total + len(best)
    assert hits / total >= 0.9


# --- queries and pipeline

def test_queries_on_given_tables(spark, given):
    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, given, "documents").collect()]
    words = [t.encode().split() for _, t in docs]
    expected = {i: (len(w), sum(m), hashlib.sha256(b" ".join(x for x, y in zip(w, m) if not y)).hexdigest())
                for (i, _), w, m in zip(docs, words, plain_cut(words, 35))}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_cover_substrings(spark, given).collect()} == expected
    data = [t.encode() for _, t in docs]
    expected = {i: (len(x), sum(m), hashlib.sha256(bytes(c for c, y in zip(x, m) if not y)).hexdigest())
                for (i, _), x, m in zip(docs, data, plain_cut(data, 400))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in queries.op8_deep_shallow_suffixes(spark, given).collect()} == expected
    prints = [plain_fingerprint(t) for _, t in docs]
    expected = {i: (f"{p:016x}", docs[c][0]) for (i, _), p, c in zip(docs, prints, plain_components(prints, 4))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_tiles(spark, given).collect()} == expected
    pages = [(r["page_id"], r["url"], r["html"]) for r in table(spark, given, "pages").collect()]
    found = queries.op3_warc_archive(spark, given).collect()
    assert sorted((str(r["page_id"]), *r[1:]) for r in found) == plain_archive(pages)


def test_archive_is_what_its_manifest_names(spark):
    page = lambda k: spark.createDataFrame([(k, "http://a", f"payload {k}")], "page_id long, url string, html string")
    folder = warc.write(page(1), new_folder(spark, "test-warc"))
    with pytest.raises(Exception, match="already holds an archive"):
        warc.write(page(2), folder)
    place = folder.removeprefix("file://").removeprefix("file:")
    with open(f"{place}/part-000099-00000.warc.gz", "wb") as stray:
        stray.write(gzip.compress(b"left by a write that died"))
    assert [r["page_id"] for r in warc.read(spark, folder).collect()] == [1]
    os.remove(f"{place}/{warc.MANIFEST}")
    with pytest.raises(Exception):
        warc.read(spark, folder)


def plain_near_copies(texts, words=5, radius=18, share=0.8):
    """Components of texts whose fingerprints are within ``radius`` bits and whose sets of shingles have the similarity ``share``."""
    split = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for t in texts]
    sets = [{b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} for w in split]
    prints = np.array([plain_fingerprint(t, words) for t in texts], np.uint64)
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= radius).tolist():
            if root(i) != root(j) and len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]) - 1e-9:
                label[root(i)] = root(j)
    return [root(k) for k in range(len(texts))]


def plain_pipeline(docs):
    """What the first three stages keep of ``docs`` (rows as dicts): id and text. Verdicts of the rules come from the operator."""
    kept = [d for d in docs if d["keep"]]
    label = plain_near_copies([d["text"] for d in kept])
    best = {}
    for d, c in zip(kept, label):
        key = (d["doc_id"] is None, d["doc_id"] or 0)
        if c not in best or key < best[c][0]:
            best[c] = (key, d)
    kept = [d for _, d in best.values()]
    data = [(d["text"] or "").encode() for d in kept]
    return {d["doc_id"]: bytes(c for c, y in zip(x, m) if not y).decode(errors="ignore")
            for d, x, m in zip(kept, data, plain_cut(data, corpus_pipeline.REPEAT_BYTES))}


@pytest.mark.parametrize("source", ["given", "awkward"])
def test_pipeline(spark, request, source):
    docs = table(spark, request.getfixturevalue("given"), "documents") if source == "given" else request.getfixturevalue("awkward")
    judged = quality.judge(docs, into="verdict").collect()
    expected = plain_pipeline([{"doc_id": r["doc_id"], "text": r["text"], "keep": r["verdict"]["kept"]} for r in judged])
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stored(stage(spark, now, ""), name)
        assert now.columns == docs.columns and [t for _, t in now.dtypes] == [t for _, t in docs.dtypes]
    rows = now.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == expected and len(rows) == len(expected)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    before = {r["doc_id"]: r.asDict() for r in judged}
    assert all(r[c] == before[r["doc_id"]][c] for r in rows for c in docs.columns if c not in ("text", "n_chars"))
    packed = corpus_pipeline.STAGES[3][1](spark, now, "").collect()
    assert {r["doc_id"] for r in packed} == set(expected)


def test_repeats_of_over_fifty_words_go(spark, given):
    """Stage 3 on the given texts: passages of 51 to 60 words of a text, put into other documents, are cut; the rest stays."""
    pool = [t.split() for (t,) in table(spark, given, "documents").where("length(text) > 3000").select("text").limit(20).collect()]
    rng, rows, planted = random.Random(2), [], []
    for k, words in enumerate(pool):
        passage = words[100:151 + k % 10]
        planted.append(" ".join(passage))
        for copy in range(3):
            own = [f"{rng.choice(words[:40])}{rng.randrange(10**6)}" for _ in range(120)]
            rows.append((len(rows), " ".join([*own[:60], *passage, *own[60:]]), " ".join(own), k))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_strings(spark, docs, "").collect()}
    caught = sum(planted[k] not in got[i] and len(got[i]) <= len(own) + 40 for i, _, own, k in rows)
    assert caught / len(rows) >= 0.95
    kept = sum(set(own.split()[:59] + own.split()[61:]) <= set(got[i].split()) for i, _, own, _ in rows)
    assert kept / len(rows) >= 0.95


def test_pipeline_of_nothing(spark, nothing):
    now = nothing
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, ""), name)
    assert now.count() == 0 and re.match("doc_id", now.columns[0])
