"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

import pytest

CLASHING = ["id", "body", "chunk", "row", "order", "quality", "fp", "component_id", "kept", "ids", "start", "words", "n_words", "end"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng: random.Random, words: int) -> str:
    pool = ["the", "of", "and", "to", "in", "a", "is", "that", "stone", "river", "Over", "hill.", "light,", "été", "漢字", "42", "x"]
    return " ".join(rng.choice(pool) + (str(rng.randrange(400)) if rng.random() < 0.5 else "") for _ in range(words))


def awkward_texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(5)
    passage, long_text = prose(rng, 120), prose(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "one two three", passage, passage, passage + " tail " + passage, long_text]
    texts += ["É" * 900, "é" * 900, "ab " * 500, "a\x1fb\x85c  d \n e ", "<|endoftext|> and <b>", "\r\n\x0b\x0c"]
    texts += [prose(rng, rng.randrange(5, 200)) for _ in range(20)]
    texts += [prose(rng, 60) + " " + passage[:rng.randrange(300, 700)] + " " + prose(rng, 40) for _ in range(12)]
    base = prose(rng, 400).split()
    for k in range(6):
        texts.append(" ".join(base[:50 * k] + [f"new{k}"] + base[50 * k:]))
    rows = [(k * 3, t, ["en", "de", None, "xx"][k % 4]) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], rows[0], (None, passage, "en"), (None, None, None), (7, "same id, other text", "fr")]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, g, "src", len(t) if t is not None else None, *["clash"] * len(CLASHING)) for i, t, g in awkward_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def given(spark):
    import os
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the given tables")
    return folder
