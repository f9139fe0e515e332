"""Quality rules, BPE, packing and language model against plain models."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from alertfold.llm import bpe, gru, lm, packing, quality, queries, repeats
from alertfold.llm.words import WordEncoder
from tests.llm.conftest import awkward_texts

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def base_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def divergence(counts, shares):
    p, q = np.array(counts) / sum(counts), np.array(shares) / sum(shares)
    m = (p + q) / 2
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt((part(p) + part(q)) / 2)


def test_quality_measures(awkward, nothing):
    rows = quality.judge(awkward.drop("quality")).collect()
    assert len(rows) == awkward.count() and quality.judge(nothing).count() == 0
    for r in rows:
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == base_measures(r["text"])
        assert q["base_failed"] == (q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"])
        assert not (q["kept"] and q["base_failed"]) and (q["class_distance"] is None) == (q["word_chars"] < 200)
        assert (q["word_distance"] is None) == (r["lang"] not in quality.COMMON_WORDS or q["n_words"] < 100)


def test_quality_distances(spark):
    text = "The cat of the house AND 12 dogs, that is it. " * 12
    q = quality.judge(spark.createDataFrame([(text, "en")], "text string, lang string")).first()["quality"]
    words = text.split()
    known = quality.COMMON_WORDS["en"]
    counts = [sum(w in (k, k.capitalize()) for w in words) for k in known]
    assert q["word_distance"] == pytest.approx(divergence([*counts, len(words) - sum(counts)], [*known.values(), 100 - sum(known.values())]))
    body = "".join(words)
    upper, digit, punct = sum(c.isupper() for c in body), sum(c.isdigit() for c in body), sum(c in ".," for c in body)
    assert q["class_distance"] == pytest.approx(
        divergence([len(body) - upper - digit - punct, upper, digit, punct, 0], quality.CLASS_SHARES["en"]))


def test_quality_verdicts(spark):
    rng = random.Random(1)
    good = " ".join(rng.choice(["the", "of", "and", "to", "river", "stone", "hills", "light"]) + str(rng.random())[9:10].replace("5", "") for _ in range(300))
    clean = re.sub(r"\d", "", good)
    rows = [(1, clean, "en"), (2, clean.upper(), "en"), (3, "#$%& *** ||| " * 3 + " ".join(f"%%{k}##" for k in range(200)), "en"), (4, clean, None)]
    found = {r["doc_id"]: r["quality"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[1]["class_distance"] <= 0.25 and found[1]["word_distance"] <= 0.42 and found[4]["word_distance"] is None
    assert found[2]["class_distance"] > 0.25 and found[3]["class_distance"] > 0.25 and not found[3]["kept"]


def test_text_without_common_words_is_rejected(spark):
    rng = random.Random(2)
    for lang, known in quality.COMMON_WORDS.items():
        text = lambda share: " ".join(
            rng.choice(list(known)) if k % 100 < share else "".join(rng.choice("abcdefghij") for _ in range(7)) for k in range(300))
        rows = [(share, text(share), lang) for share in (0, 2, 12, 25, 40)] + [(100, text(0), None)]
        found = {r["share"]: r["quality"] for r in quality.judge(spark.createDataFrame(rows, "share long, text string, lang string")).collect()}
        assert {k: q["kept"] for k, q in found.items()} == {0: False, 2: False, 12: True, 25: True, 40: True, 100: True}
        assert not any(q["base_failed"] or (q["class_distance"] or 0) > 0.25 for q in found.values())
        total = sum(known.values())
        assert all(found[k]["common_distance"] == pytest.approx(divergence([k, 100 - k], [total, 100 - total])) for k in (0, 2, 12, 25, 40))
        assert found[100]["common_distance"] is None


def test_quality_is_native(spark):
    plan = quality.judge(spark.range(9).selectExpr("cast(id as string) AS text", "'en' AS lang"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_segment_tree_against_library(library):
    rng = random.Random(1)
    letters = "abcde fghtheing\n\t '’é漢字½²Ⅷ_09#*\x1c\x85  　😀\r\x0b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", "a" * 3000, "ab" * 400 + " " * 300, "  x  ", "x ", " x", "\n x", "<|endoftext|> a", "I'll we've 's"]
    encode = WordEncoder(bpe.SegmentTreeBpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN).encode, entries=500)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at:at + 100], encode(texts[at:at + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_encode_and_decode(awkward, nothing, library):
    encoded = bpe.encode(awkward.drop("ids"), RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text", "lang"))
    rows = bpe.decode(encoded, RANKS).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(nothing, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def check_pieces(rows, expected, window):
    """``expected``: ids of the rows by id, as a multiset for ids that repeat."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] * 4 == len(r["ids"])
            at += r["length"]
        assert at == window or at & (at - 1) == 0 and at < window
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for doc, texts in expected.items():
        if len(texts) == 1:
            assert b"".join(ids for _, ids, _ in sorted(by_doc[doc])) == texts[0]
            assert {n for *_, n in by_doc[doc]} == {len(texts[0]) // 4}
        assert sum(len(ids) for _, ids, _ in by_doc[doc]) == sum(map(len, texts))


@pytest.mark.parametrize("window,shard", [(2048, 512), (64, 7)])
def test_packing(awkward, nothing, window, shard):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(TOKENIZER)
    model.encode_special_tokens = True
    expected = {}
    for doc, text, _ in awkward_texts():
        ids = model.encode(text or "", add_special_tokens=False).ids
        expected.setdefault(doc, []).append(np.array([*ids, 1], "<u4").tobytes())
    rows = packing.pack(awkward.drop("ids", "start"), TOKENIZER, 1, window=window, shard_docs=shard).collect()
    check_pieces(rows, expected, window)
    assert packing.pack(nothing, TOKENIZER, 1).count() == 0


def test_added_tokens_have_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x <|endoftext|", "\n <|endoftext|>  y ", "plain text"]
    texts += [t or "" for _, t, _ in awkward_texts()]
    expected = {k: [np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()] for k, t in enumerate(texts)}
    assert np.array([64, 220, 50256, 275, 1], "<u4").tobytes() == expected[0][0]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(packing.pack(frame, TOKENIZER, 1, added_tokens=True).collect(), expected, 2048)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    whole = {r["doc_id"]: r["doc_tokens"] for r in queries.op2_bm25_packing(spark, str(tmp_path)).collect()}
    assert whole == {k: len(ids) // 4 for k, (ids,) in expected.items()}


def test_bm25_ranking():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    index, unused = packing.ShardIndex(texts), np.array([rng.random() < 0.7 for _ in texts])
    counts = [Counter(t.split()) for t in texts]
    mean = sum(sum(c.values()) for c in counts) / len(texts)
    idf = lambda w: math.log((60 - (n := sum(w in c for c in counts)) + 0.5) / (n + 0.5)) if sum(w in c for c in counts) > 1 else 0
    for seed in (0, 9, 33):
        score = {}
        for d, c in enumerate(counts):
            long = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(max(idf(w), 0) * c[w] * 2.2 / (c[w] + long) for w in counts[seed] if w in c)
            if s > 0 and unused[d]:
                score[d] = s
        found = index.ranking(seed, unused)
        assert set(found) == set(score)
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(found, found[1:]))


def test_related_documents_share_windows():
    topics = [[f"t{t}w{k}" for k in range(12)] for t in range(4)]
    texts = [" ".join(topics[k % 4]) for k in range(40)]
    packer = packing._Packer(100, 0)
    pieces = list(packing._fill(texts, [bytes(4 * 20)] * 40, 0, packer))
    windows = {}
    for row, *_, sequence, _ in pieces:
        windows.setdefault(sequence, set()).add(row % 4)
    assert sum(len(t) == 1 for t in windows.values()) >= len(windows) - 4


def scored_by_hand(rows):
    words = [lm.words_of(t) + [b"\n"] for _, t, _ in rows]
    training = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, *_ in rows]
    counts = Counter(w for ws, t in zip(words, training) if t for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((str(i), not t, len(ws), sum(counts[w] > 0 for w in ws), n,
                   round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
                  for (i, *_), ws, t in zip(rows, words, training))


@pytest.mark.parametrize("head", [65536, 40, 1])
def test_base_scores(awkward, head):
    rows = lm.score(awkward, settings=lm.Settings(vocabulary=min(head, 64) + 2, head=head)).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == scored_by_hand(awkward_texts())
    assert all(r["score"] < 0 for r in rows)


def test_language_model_edges(awkward, nothing):
    assert lm.score(nothing).count() == 0
    held_out = awkward.where("crc32(cast(doc_id as string)) % 5 = 1")
    rows = lm.score(held_out).collect()
    assert rows and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 for r in rows)


def test_language_model_is_a_distribution():
    """The probabilities of all next tokens add up to 1, also for the last class, which is not full."""
    weights = gru.initial(np.log(np.full(70, 1 / 70)), 8, 32, 1)
    weights["class"] += 0.3
    model = gru.Gru(weights)
    h = np.random.default_rng(0).standard_normal((1, 8)).astype(gru.F32)
    total = sum(math.exp(model._output(h, np.array([k]), None)[0][0]) for k in range(70))
    assert total == pytest.approx(1, abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    weights = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in gru.initial(np.log(np.full(12, 1 / 12)), 5, 4, 1).items()}
    texts = [rng.integers(0, 12, n) for n in (9, 4, 6)]
    kind, gru.F32 = gru.F32, np.float64
    try:
        loss = lambda w: -gru.Gru(w).score(texts, 2, 64).sum()
        squares = {k: np.zeros_like(v) for k, v in weights.items()}
        moved = {k: v.copy() for k, v in weights.items()}
        gru.Gru(moved).train(texts, squares, rate=0.0, lanes=2, window=64)
        for name, value in weights.items():
            for at in list(np.ndindex(value.shape))[::max(1, value.size // 7)]:
                plus, minus = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
                plus[name][at] += 1e-5
                minus[name][at] -= 1e-5
                slope = (loss(plus) - loss(minus)) / 2e-5 / (2 * 64)
                assert squares[name][at] == pytest.approx(slope ** 2, rel=1e-3, abs=1e-12), name
    finally:
        gru.F32 = kind


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(2)
    weights = {k: v + (0.2 * rng.standard_normal(v.shape)).astype(gru.F32) for k, v in gru.initial(np.log(np.full(20, 0.05)), 6, 8, 1).items()}
    texts = [rng.integers(0, 20, n) for n in (70, 3, 1, 40, 41)]
    model = gru.Gru(weights)
    alone = np.array([model.score([t], 1, 1000)[0] for t in texts])
    assert model.score(texts, 2, 8) == pytest.approx(alone, rel=1e-4)


def test_model_learns_order():
    rng = random.Random(0)
    texts = [np.array([2 + (s + k) % 6 for k in range(60)] + [gru.END]) for s in (rng.randrange(6) for _ in range(400))]
    model = gru.Gru(gru.initial(np.log(np.full(8, 1 / 8)), 12, 4, 0))
    squares = {k: np.full_like(v, 1e-5) for k, v in model.w.items()}
    for _ in range(4):
        model.train(texts[:300], squares)
    per_token = model.score(texts[300:]).sum() / sum(map(len, texts[300:]))
    assert per_token > 0.6 * math.log(1 / 8)


def test_averaged_models_beat_unigrams(spark, given):
    rows = queries.op10_gated_language_model(spark, given).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_queries_on_given_tables(spark, given, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{given}/documents.parquet").collect()}
    ids = {k: np.array(library.encode_ordinary(t), "<u4") for k, t in docs.items()}
    rows = queries.op4_segment_tree_bpe(spark, given).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids[r["doc_id"]]), hashlib.sha256(ids[r["doc_id"]].tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    for r in queries.op2_bm25_packing(spark, given).collect():
        whole = np.append(ids[r["doc_id"]], 1).astype("<u4")
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"]:r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(whole)
    rows = queries.op9_quality_divergence(spark, given).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows} == {
        k: base_measures(t) for k, t in docs.items()}


def test_masks_of_a_chunk_take_few_bytes_a_unit():
    total, first = 2_000_000, np.arange(0, 1_900_000, 500)
    parts = [(first, first, first + 300, first.view(np.uint64), first.view(np.uint64))]
    chunk = repeats.Chunk(272, np.zeros(1, np.int64), total, parts)
    tracemalloc.start()
    starts = chunk.spread(np.ones(len(first), bool))
    gone = chunk.covered(starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want_starts, want = np.zeros(total, bool), np.zeros(total, bool)
    for a in first.tolist():
        want_starts[a:a + 301] = True
        want[a:a + 300 + 272] = True
    assert (starts == want_starts).all() and (gone == want).all() and peak < 12 * total


def test_new_words_are_encoded_together():
    path = public_tokenizers.path("byte_bpe_50k.json")
    packing._encoder.cache_clear()
    words = ["a", "b\n", "\nc", "d\r\n\r\ne", "é", "日本", "it's", "1234", "x\ty", "..!", "<|endoftext|>", "​z"] + [f"w{k}" for k in range(5000)]
    encoder = packing._encoder(path)
    assert encoder._encode_words(words) == encoder._encode([" " + w for w in words])
    text = "first " + " ".join(words)
    assert encoder([text]) == encoder._encode([text])
    encoder.forget()
    assert not encoder._known


def test_columns_are_encoded_by_distinct_words():
    rng = random.Random(8)
    odd = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u2029\u3000\u200b\x00\x7f"
    texts = ["".join(rng.choice(odd if rng.random() < 0.4 else "ab 1.'sé日") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [f"{a}x{c}y {c} z{c}" for c in odd for a in ("", " ")] + ["w\nw 's it's"] * 3 + [None, ""]
    column, encoder = pa.array(texts), packing._encoder(TOKENIZER)
    assert encoder(column) == encoder._encode([t or "" for t in texts])
    assert not encoder._known
    assert encoder(pa.array([], pa.string())) == []
    index = packing.ShardIndex(column)
    split = [(t or "").split() for t in texts]
    often = Counter(w for ws in split for w in set(ws))
    for ws, terms in zip(split, index.terms_of):
        assert len(terms) == sum(1 < often[w] and 2 * often[w] < len(texts) + 0.5 for w in set(ws))
    groups = list(packing._shards(pa.array(["x" * 100_000] * 1300), 7))
    assert all(n == 7 for g in groups[:-1] for n in g) and sum(map(sum, groups)) == 1300
    assert max(map(sum, groups)) * 100_000 <= packing.ENCODE_CHARS


def test_softmax_of_rows_side_by_side():
    x = np.random.default_rng(3).standard_normal((32, 200)).astype(np.float32) * 9
    target = np.arange(200) % 32
    want = x - np.log(np.exp(x.astype(np.float64)).sum(0))
    log_p, parts, total = gru._softmax(x.copy(), target)
    assert np.allclose(log_p, want[target, np.arange(200)], atol=1e-5) and np.allclose(parts / total, np.exp(want), atol=1e-6)
