"""Licence scans against a plain model and against SQL."""

import os
import re

import duckdb

from alertfold.llm import licenses, queries


def plain_scan(text):
    ids = []
    for sentence in re.split(r"\n|[.!?;:]+(?=[\x20\x09-\x0D]|$)", (text or "").lower()):
        words = re.sub("[^a-z0-9]+", " ", sentence).strip(" ")
        found = licenses.SENTENCES.get(words) or next(
            (i for p, i in sorted(licenses.PREFIXES.items(), key=lambda x: -len(x[0])) if words.startswith(p)), None)
        if found:
            ids.append(found)
    rest, names = list(ids), set()
    for name, run in licenses.RULES:
        at = 0
        while at + len(run) <= len(rest):
            if tuple(rest[at:at + len(run)]) == run:
                names.add(name)
                rest[at:at + len(run)] = [None]
            at += 1
    return ids, sorted(names), sum(x is not None for x in rest)


GRANT, NOTICE, AS_IS = (s.capitalize() for s, i in licenses.SENTENCES.items() if i in ("MitGrant", "MitNotice", "MitAsIs"))
TEXTS = [
    "Prose.\nLicensed under the Apache License, Version 2.0.\nMore prose; all RIGHTS reserved!", "All rights reserved",
    f"{GRANT}:\n{NOTICE}. {AS_IS}.", f"{NOTICE}.\n{GRANT}.", f"{GRANT}. Nothing. {NOTICE}. {GRANT}. {NOTICE}. {AS_IS}.",
    "Copyright (c) 2020 Somebody. All rights reserved.", "copyright 2019\nWords.\ncopyright 2020\nall rights reserved\nall rights reserved",
    "SPDX-License-Identifier: MIT", "(c) Copyright 2001 x", "Copyrighted is another word.", "This is licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.\n" * 500, None, "", "....", "Neither the name. You may obtain a copy of the License at: http://x",
]


def test_scan(spark, awkward, nothing):
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, license string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(frame).collect()}
    for k, text in enumerate(TEXTS):
        assert (got[k]["ids"], got[k]["licenses"], got[k]["unmatched"]) == plain_scan(text), text
    assert got[2]["licenses"] == ["MIT"] and got[5]["licenses"] == ["Proprietary"] and got[15]["unmatched"] == 1
    assert licenses.scan(awkward).count() == awkward.count() and licenses.scan(nothing).count() == 0


def test_scan_is_native(spark):
    plan = licenses.scan(spark.range(9).selectExpr("cast(id as string) AS text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_scan_against_sql(spark, given):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(given, 'documents.parquet')}'")
    want = con.execute(queries.ORACLES["op1_license_sentences"]).fetchall()
    assert sorted(map(tuple, queries.op1_license_sentences(spark, given).collect())) == sorted(want)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    con.register("mine", frame.toPandas())
    want = con.execute(licenses.oracle("mine")).fetchall()
    got = licenses.scan(frame).selectExpr(
        "doc_id", "cast(size(license.ids) as long)", "array_join(license.ids, '|')", "array_join(license.licenses, '|')", "license.unmatched")
    assert sorted(map(tuple, got.collect())) == sorted(want)
