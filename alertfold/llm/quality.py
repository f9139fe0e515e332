"""Quality rules by distribution divergence (DataFrame expressions only).

A document is compared with references of its language: its character classes and its common words are turned into two
histograms, and each must lie within a Jensen-Shannon distance of the reference. In the second one the other words outweigh
the common ones, so the share of common words is compared by itself too, with a limit per language. Guards of minimum length keep short
documents out of a comparison for which they are too short. Before that, two base rules reject documents with very few
words and documents in which most words belong to repeated passages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from alertfold.llm.common import SPACES, let

# --- fixed values: share of all words, in percent, that each common word has in running text of its language
COMMON_WORDS = {
    "de": {
        "der": 3.2, "die": 3.3, "und": 2.8, "in": 1.9, "den": 1.2, "von": 1.0, "zu": 1.0, "das": 1.0, "mit": 0.9,
        "sich": 0.7, "des": 0.7, "auf": 0.7, "für": 0.7, "ist": 0.8, "im": 0.8, "dem": 0.6, "nicht": 0.7, "ein": 0.6,
        "eine": 0.6, "als": 0.5,
    },
    "en": {
        "the": 6.2, "of": 3.2, "and": 2.9, "to": 2.6, "in": 2.2, "a": 2.2, "is": 1.0, "that": 1.0, "it": 0.9,
        "for": 0.9, "on": 0.7, "was": 0.8, "with": 0.7, "as": 0.7, "be": 0.6, "by": 0.6, "this": 0.5, "are": 0.5,
        "from": 0.4, "at": 0.5,
    },
    "es": {
        "de": 5.4, "la": 3.4, "que": 2.8, "el": 2.5, "en": 2.4, "y": 2.3, "a": 1.8, "los": 1.6, "del": 1.1, "se": 1.1,
        "las": 1.0, "por": 0.9, "un": 0.9, "para": 0.8, "con": 0.8, "no": 0.8, "una": 0.7, "su": 0.6, "es": 0.6,
        "al": 0.5,
    },
    "fr": {
        "de": 4.3, "la": 2.8, "le": 2.3, "et": 2.2, "les": 1.9, "des": 1.7, "en": 1.4, "un": 1.2, "du": 1.2,
        "une": 1.1, "que": 1.0, "est": 0.9, "pour": 0.9, "dans": 0.9, "qui": 0.8, "par": 0.6, "sur": 0.6, "au": 0.6,
        "pas": 0.5, "il": 0.5,
    },
}
# Distance of all common words, taken together, at which a text is no running text of its language: 0.6 of the distance of
# a text without common words, which is about a quarter of the usual share of common words.
COMMON_LIMITS = {"de": 0.217, "en": 0.242, "es": 0.256, "fr": 0.235}
# Shares of the characters of words: lower-case and caseless letters, upper-case letters, digits, punctuation, other signs.
CLASS_SHARES = {
    "de": (91.0, 5.5, 0.5, 2.8, 0.2), "en": (93.0, 3.0, 0.8, 3.0, 0.2),
    "es": (93.5, 2.8, 0.6, 2.9, 0.2), "fr": (93.0, 2.8, 0.6, 3.4, 0.2),
}
SYMBOL = r"[#*$%&|<>]"
SIGN = r"[\p{S}#*%&@_\\/]"
PUNCTUATION = r"[\p{P}&&[^#*%&@_\\/]]"
# --- end of fixed values


@dataclass(frozen=True)
class Rules:
    """``class_guard``: characters of words, ``word_guard``: words, from which a histogram is compared at all."""

    min_words: int = 10
    repeat_window: int = 5
    max_repeat_percent: int = 20
    class_guard: int = 200
    word_guard: int = 100
    max_class_distance: float = 0.25
    max_word_distance: float = 0.42
    max_common_distance: dict[str, float] = field(default_factory=lambda: COMMON_LIMITS)
    common_words: dict[str, dict[str, float]] = field(default_factory=lambda: COMMON_WORDS)
    class_shares: dict[str, tuple[float, ...]] = field(default_factory=lambda: CLASS_SHARES)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeated_words(words: Column, width: int) -> Column:
    """How many words lie in a ``width``-word window that occurs twice or more among ``words``."""

    def covered(pairs: Column) -> Column:
        key = lambda i: F.get(pairs, i)["key"]
        starts = F.sort_array(F.transform(
            F.filter(pairs, lambda x, i: x["key"].eqNullSafe(key(i - 1)) | x["key"].eqNullSafe(key(i + 1))), lambda x: x["at"]))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def among(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    keys = F.slice(F.transform(
        words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)])), 1, F.size(words) - width + 1)
    return F.when(F.size(words) > width, let(keys, among)).otherwise(F.lit(0).cast("long"))


def _distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence to base 2) of two histograms of equal length."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    both = lambda n, m: F.zip_with(
        counts, shares, lambda x, y: let((x / n + y / m) / 2, lambda mid: (part(x / n, mid) + part(y / m, mid)) / 2))
    return F.sqrt(F.greatest(total(both(total(counts), total(shares))), F.lit(0.0)))


def _by_language(table: dict[str, list[float] | list[str]], lang: Column) -> Column:
    """The entry of ``lang`` as an array; null for a language without one."""
    found = F.lit(None)
    for name, values in table.items():
        found = F.when(lang == name, F.array(*map(F.lit, values))).otherwise(found)
    return found


def measures(text: Column, lang: Column, rules: Rules = Rules()) -> Column:
    """One struct per document: base counts, the distances (null below the guards, those of words also for a language
    without reference) and the verdict."""
    languages = rules.common_words
    accepted = [form for words in languages.values() for word in words for form in (word, word.capitalize())]
    shares = {name: [*words.values(), 100 - sum(words.values())] for name, words in languages.items()}
    together = {name: [sum(words.values()), 100 - sum(words.values())] for name, words in languages.items()}
    every_class = {name: list(map(float, row)) for name, row in rules.class_shares.items()}

    def class_distance(word_chars: Column, body: Column) -> Column:
        marked = [_count(body, p) for p in (r"\p{Lu}", r"\p{N}", PUNCTUATION, SIGN)]

        def nearest(counts: Column) -> Column:
            own = _by_language(every_class, lang)
            others = [_distance(counts, F.array(*map(F.lit, row))) for row in every_class.values()]
            return F.when(own.isNotNull(), _distance(counts, own)).otherwise(F.least(*others))

        return F.when(word_chars >= rules.class_guard, let(
            F.array(*marked), lambda m: let(
                F.transform(F.array(word_chars - (m[0] + m[1] + m[2] + m[3]), m[0], m[1], m[2], m[3]),
                            lambda x: F.greatest(x, F.lit(0)).cast("double")), nearest)))

    def word_distances(words: Column) -> Column:
        def against(common: Column) -> Column:
            expected = _by_language({k: list(v) for k, v in languages.items()}, lang)
            counts = F.transform(expected, lambda k: F.size(
                F.filter(common, lambda w: w == k)).cast("double"))
            rest = lambda c: F.size(words) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
            return let(counts, lambda c: let(rest(c), lambda n: F.struct(
                _distance(F.concat(c, F.array(n)), _by_language(shares, lang)).alias("word"),
                _distance(F.array(F.size(words) - n, n), _by_language(together, lang)).alias("common"))))

        known = lang.isin(*languages)
        return F.when(known & (F.size(words) >= rules.word_guard),
                      let(F.transform(F.filter(words, lambda w: w.isin(*accepted)), F.lower), against))

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    def of_words(words: Column) -> Column:
        body = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.char_length(body).cast("long").alias("word_chars"),
            _repeated_words(words, rules.repeat_window).alias("n_repeat_words"),
            let(body, lambda b: class_distance(F.char_length(b).cast("long"), b)).alias("class_distance"),
            word_distances(words).alias("distances"))

    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, SPACES), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    limit = F.lit(None).cast("double")
    for name, value in rules.max_common_distance.items():
        limit = F.when(lang == name, value).otherwise(limit)

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < rules.min_words) | (
            100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
        close = (F.coalesce(m["class_distance"], F.lit(0.0)) <= rules.max_class_distance) & (
            F.coalesce(m["distances"]["word"], F.lit(0.0)) <= rules.max_word_distance) & (
            F.coalesce(m["distances"]["common"] <= limit, F.lit(True)))
        return F.struct(
            m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
            _count(body, SYMBOL).alias("n_symbols"), let(lines, of_lines).alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), (~failed & close).alias("kept"),
            m["class_distance"].alias("class_distance"), m["distances"]["word"].alias("word_distance"),
            m["distances"]["common"].alias("common_distance"))

    return let(let(words, of_words), judged)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", into: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the struct column ``into`` of :func:`measures` (an existing column of that name is replaced).

    No shuffle: every row is judged by itself. A null text counts as empty: no words, rejected by the base rules. A null
    or unknown language is compared with the nearest class reference and with no common words. Repeated rows get equal
    verdicts, an empty table gives an empty table.
    """
    return docs.withColumn(into, measures(F.col(text), F.col(lang), rules))
