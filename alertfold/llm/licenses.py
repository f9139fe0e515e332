"""Licence scans by sentence rules (DataFrame expressions only).

A text is cut into sentences, each is normalised, and sentences that licences are known to use get an identifier. The
identifiers of a document, in order, are matched against licence rules, which are tried in their own order: a rule is a
run of identifiers, and what it has matched is taken out before the next one, so that long rules come before those they
contain. Identifiers that no rule takes are reported as unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertfold.llm.common import let

# --- fixed values: normalised sentences and their identifiers; a sentence that only begins like one of PREFIXES has its id
SENTENCES = {
    "all rights reserved": "AllRights",
    "licensed under the apache license version 2 0": "Apache2",
    "licensed under the apache license version 2 0 the license": "Apache2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "MitAsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GplFree",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplNoWarranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdRedist",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "BsdEndorse",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
}
PREFIXES = {
    "copyright ": "Copyright", "c copyright ": "Copyright",
    "spdx license identifier mit": "MitRef", "spdx license identifier apache 2 0": "Apache2",
    "spdx license identifier gpl 3 0": "Gpl3",
}
RULES = (
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("Apache-2.0", ("Apache2", "ApacheUse", "ApacheCopy")),
    ("GPL", ("GplFree", "GplNoWarranty")),
    ("BSD-3-Clause", ("BsdRedist", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdRedist",)),
    ("Proprietary", ("Copyright", "AllRights")),
    ("Apache-2.0", ("Apache2",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitGrant",)),
    ("GPL-3.0", ("Gpl3",)),
    ("GPL", ("GplFree",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("Proprietary", ("AllRights",)),
)
# --- end of fixed values

# A sentence ends at a line break, or at a mark that white space or the end follows: "2.0" stays whole.
SENTENCE_END = r"\n|[.!?;:]+(?=[\x20\x09-\x0D]|$)"
NOT_WORD = "[^a-z0-9]+"


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in order."""
    plain = F.transform(F.split(F.lower(text), SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, NOT_WORD, " ")))
    begins = {p: i for p, i in sorted(PREFIXES.items(), key=lambda x: -len(x[0]))}
    known = F.filter(plain, lambda s: s.isin(*SENTENCES) | s.rlike("^(" + "|".join(begins) + ")"))

    def name(s: Column) -> Column:
        found = F.lit(None)
        for begin, identifier in reversed(begins.items()):
            found = F.when(s.startswith(begin), identifier).otherwise(found)
        for sentence, identifier in SENTENCES.items():
            found = F.when(s == sentence, identifier).otherwise(found)
        return found

    return F.transform(known, name)


def matches(ids: Column) -> Column:
    """Struct of ``licenses`` (distinct, in name order) and ``unmatched``, the number of identifiers that no rule took."""
    empty = F.array().cast("array<string>")
    state = F.struct(F.concat(F.lit("  "), F.array_join(ids, "  "), F.lit("  ")).alias("rest"), empty.alias("found"))
    def taken(licence: str, run: str):
        def step(s: Column) -> Column:
            hit = s["rest"].contains(run)  # what is taken leaves a mark, so that its neighbours don't become a run
            return F.struct(F.when(hit, F.replace(s["rest"], F.lit(run), F.lit(" - "))).otherwise(s["rest"]).alias("rest"),
                            F.when(hit, F.array_append(s["found"], licence)).otherwise(s["found"]).alias("found"))
        return step

    for licence, sequence in RULES:
        state = let(state, taken(licence, " " + "  ".join(sequence) + " "))
    left = lambda s: F.size(F.filter(F.split(s["rest"], " "), lambda x: (x != "") & (x != "-"))).cast("long")
    return let(state, lambda s: F.struct(F.sort_array(F.array_distinct(s["found"])).alias("licenses"), left(s).alias("unmatched")))


def scan(docs: DataFrame, text: str = "text", into: str = "license") -> DataFrame:
    """``docs`` with the struct column ``into``: ``ids`` (identifiers in order), ``licenses`` and ``unmatched``.

    No shuffle: rows are scanned by themselves, whole. A null or empty text has no identifiers and no licences; repeated
    rows get equal results; an empty table gives an empty table; an existing column of that name is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, let(identifiers(whole), lambda ids: let(matches(ids), lambda m: F.struct(
        ids.alias("ids"), m["licenses"].alias("licenses"), m["unmatched"].alias("unmatched")))))


def oracle(table: str) -> str:
    """The scan in DuckDB's SQL, with the texts joined by '|'."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    begins = sorted(PREFIXES.items(), key=lambda x: -len(x[0]))
    name = "CASE " + " ".join(f"WHEN s = {quoted(s)} THEN {quoted(i)}" for s, i in SENTENCES.items()) + " " + " ".join(
        f"WHEN starts_with(s, {quoted(p)}) THEN {quoted(i)}" for p, i in begins) + " END"
    steps = "s0 AS (SELECT doc_id, ids, '  ' || array_to_string(ids, '  ') || '  ' AS rest, CAST([] AS VARCHAR[]) AS found FROM named)"
    for k, (licence, sequence) in enumerate(RULES):
        run = quoted(" " + "  ".join(sequence) + " ")
        steps += (f", s{k + 1} AS (SELECT doc_id, ids, replace(rest, {run}, ' - ') AS rest, "
                  f"CASE WHEN contains(rest, {run}) THEN list_append(found, {quoted(licence)}) ELSE found END AS found FROM s{k})")
    ending = r"\n|[.!?;:]+[\x20\x09-\x0D]|[.!?;:]+$"  # this engine has no look-ahead; white space is trimmed off anyway
    return f"""WITH named AS (
  SELECT doc_id, list_filter(list_transform(list_transform(
      string_split_regex(lower(coalesce(text, '')), '{ending}'), lambda x: trim(regexp_replace(x, '{NOT_WORD}', ' ', 'g'))),
    lambda s: {name}), lambda i: i IS NOT NULL) AS ids FROM {table}), {steps}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, '|') AS sentence_ids,
  array_to_string(list_sort(list_distinct(found)), '|') AS licenses,
  CAST(len(list_filter(string_split(rest, ' '), lambda x: x <> '' AND x <> '-')) AS BIGINT) AS n_unmatched FROM s{len(RULES)}"""
