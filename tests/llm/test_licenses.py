import random

from pyspark.sql import functions as F
import pytest

from stratocast.llm import licenses as L

from conftest import SF_MID
from llm_fixtures import docs  # noqa: F401

LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
}


@pytest.fixture(scope="module")
def scanner(spark):
    return L.train(spark.read.parquet(f"{SF_MID}/documents.parquet"))


def test_whole_table_by_its_lines(spark, scanner):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r.doc_id: r for r in L.scan(docs, scanner).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        want = [f"{i}:{LINES[x]}" for i, x in enumerate(d.text.split("\n")) if x in LINES]
        assert got[d.doc_id].paragraphs == ",".join(want) and got[d.doc_id].n_licenses == len(want)


def test_reworded_unknown_null_and_clashing_names(spark, docs, scanner):
    long = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files"
    texts = [None, "", "plain text", long, "A driver's licence is required here", "x\nreleased under the mit license\nReleased under the MIT License.", ("word " * 300_000) + "\nLicensed under CC BY-NC 4.0."]
    rows = L.scan(docs(texts), scanner).orderBy("doc_id").collect()
    assert [r.families for r in rows] == ["", "", "", "MIT", "", "MIT", "CC-BY-NC"]
    assert [r.n_licenses for r in rows] == [0, 0, 0, 1, 0, 2, 1] and rows[4].n_unknown == 1
    assert rows[5].paragraphs == "1:MIT,2:MIT"


def test_every_template_has_an_anchor(spark):
    t = spark.createDataFrame([(x,) for _, x in L.TEMPLATES], "t string")
    assert t.where(~L._has_anchor(F.col("t"))).isEmpty()


GPL = ("/*", " * This program is free software: you can redistribute it and/or modify", " * it under the terms of the GNU General Public License as published by", " * the Free Software Foundation", " */")
BSD = ("# Redistribution and use in source and binary forms, with or without", "# modification, are permitted provided that the following conditions are", "# met")
UNLICENSE = ("This is free and unencumbered software released into the", "public domain.")


def test_hard_wrapped_notices(spark, docs, scanner):
    texts = ["\n".join(x) for x in (GPL, BSD, UNLICENSE, ("int x;", *BSD, "", *GPL, "Released under the MIT License."), (BSD[0], "", *BSD[1:]))]
    rows = L.scan(docs(texts), scanner).orderBy("doc_id").collect()
    assert [r.families for r in rows[:4]] == ["GPL", "BSD", "Unlicense", "BSD,GPL,MIT"]
    assert [r.n_licenses for r in rows[:4]] == [1, 1, 1, 3] and [r.paragraphs.split(",")[-1] for r in rows[3:4]] == ["10:MIT"]
    assert "BSD" not in rows[4].families


def test_every_share_of_a_template_has_an_anchor(spark):
    t = L._templates(spark).select("tri", F.size(F.filter("tri", lambda x: ~L._has_anchor(x))).alias("free"))
    assert t.where(F.col("free") >= L.HELD_BACK * F.size("tri")).isEmpty()


def test_empty_tables(spark, docs, scanner):
    assert L.scan(docs([]), scanner).count() == 0
    assert L.train(docs([])).families[-1] == L.NONE


def test_only_plausible_paragraphs_are_classified_and_none_is_lost(spark, docs, scanner):
    """Stretches of random lines against every pair of lines, each classified."""
    rng = random.Random(4)
    pieces = [t.split()[a:a + rng.randint(3, 12)] for _, t in L.TEMPLATES for a in (0, 5, 9) if a < len(t.split())]
    noise = "the of licence and software to work copy a under".split()
    texts = []
    for _ in range(25):
        lines = [" ".join(rng.choice(pieces) if rng.random() < 0.6 else rng.choices(noise, k=rng.randint(0, 5))) for _ in range(8)]
        whole = rng.choice(L.TEMPLATES)[1].split()
        cut = sorted(rng.sample(range(1, len(whole)), 2))
        lines[3:3] = [" ".join(whole[:cut[0]]), " ".join(whole[cut[0]:cut[1]]), " ".join(whole[cut[1]:])]
        texts.append("\n".join(lines))
    d = docs(texts)
    pairs = [(i, a, z, " ".join(t.split("\n")[a:z + 1])) for i, t in enumerate(texts) for a in range(11) for z in range(a, 11)]
    every = spark.createDataFrame(pairs, "doc int, line int, to int, p string")
    marked = scanner.plausible(scanner.classify(every, "p"), "p", "hold").collect()
    assert all(r.hold for r in marked if r.family is not None) and sum(r.family is not None for r in marked) > 20
    assert not all(r.hold for r in marked)
    for r in L.scan(d, scanner).collect():
        # each reported start is that of a confirmed stretch, and each confirmed line is reported or overlapped
        mine = [m for m in marked if m.doc == r.doc_id and m.family is not None]
        starts = {(int(x.split(":")[0]), x.split(":")[1]) for x in r.paragraphs.split(",") if x}
        assert starts <= {(m.line, m.family) for m in mine} and bool(starts) == bool(mine)
        assert {(m.line, m.family) for m in mine if m.line == m.to} <= starts
