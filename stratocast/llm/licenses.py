"""Licence scan: a trained paragraph classifier, confirmed by templates;
DataFrame functions and Spark ML only.

Sparse word n-grams (those of the templates) feed a multinomial logistic
regression. It is trained on templates with words left out and on paragraphs
of the corpus that no template resembles ("none"); a held-out part sets, per
family, the probability below which a paragraph is unknown. A prediction
counts when the paragraph also holds enough of a template of that family.

A paragraph is a line or, for wrapped notices, a few consecutive lines joined
(see :func:`scan`); comment marks are no words and do not count.

Scale: a text without any anchor word (checked by one pattern)
cannot be confirmed and costs no more than that. Lines of the others are
exploded without their text; results are keyed by the text's digest, so copies
share them. Joined lines are bounded by ``SPAN`` words, so their number grows
with the lines. Only paragraphs that hold enough of some template, by an index
of the templates' trigrams, are classified; no other could be confirmed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratocast.llm.joins import salted_left_join
from stratocast.llm.words import words
from stratocast.session import ensure_checkpoint_dir

NONE = "none"
VARIANTS = 40               # training paragraphs made of each template
NEGATIVES = 4000            # corpus paragraphs in training (expected)
FEATURES = 1 << 13
PRECISION = 0.98
HELD_BACK = 0.6             # share of a template's word trigrams that a paragraph must hold
SPAN = 40                   # words that a wrapped notice may stretch over; templates have at most 29

# fixed values: openings and notices of public licences, by family
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# fixed values: every ``HELD_BACK`` share of each template's trigrams holds
# one of these (the short ones as whole words), so a confirmed paragraph must
ANCHORS = ("licen", "copyright", "redistribut", "warrant", "permission", "permitted", "unencumbered", "domain", "released", "software", "attribution",
           "source", "dedicated", "conditions", "granted", "compliance", "mozilla", "contributors", "derived", "waived", "extent")
SHORT_ANCHORS = ("cc", "copy", "gnu")


def _grams(w: Column, n: int) -> Column:
    at = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))
    return F.when(F.size(w) >= n, at).otherwise(F.array().cast("array<string>"))


def _has_anchor(text: Column) -> Column:
    return text.rlike(rf"(?i){'|'.join(ANCHORS)}|(?<![a-z0-9])(?:{'|'.join(SHORT_ANCHORS)})(?![a-z0-9])")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row. A filter or a later column
    that uses a plain one gets its whole expression in its place, several times
    over; nothing is moved below a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _with_grams(paragraphs: DataFrame, text: str) -> DataFrame:
    """Add ``w`` (words), ``terms`` (distinct words and pairs) and ``tri``."""
    df = _once(paragraphs, w=words(F.col(text)))
    return _once(df, terms=F.array_distinct(F.concat("w", _grams(F.col("w"), 2))), tri=F.array_distinct(_grams(F.col("w"), 3)))


def _templates(spark: SparkSession) -> DataFrame:
    return _with_grams(spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, text string"), "text")


def _share(tri: Column, template: Column) -> Column:
    """Share of a template's trigrams (or of its words, if it has none)."""
    return F.size(F.array_intersect(tri, template)) / F.greatest(F.size(template), F.lit(1))


@dataclass
class Scanner:
    model: LogisticRegressionModel
    families: list[str]
    thresholds: list[float]
    vocabulary: Column
    templates: list[tuple[str, list[str]]]

    def plausible(self, paragraphs: DataFrame, text: str, name: str) -> DataFrame:
        """Add ``name``: whether the paragraph holds enough of some template.

        The paragraph's trigrams are looked up in the index of all templates'
        trigrams; only what is found is counted per template. Whatever
        :meth:`classify` confirms is plausible.
        """
        every = sorted({t for _, tri in self.templates for t in tri})
        df = _once(paragraphs, _w=words(F.col(text)))
        df = _once(df, _tri=F.array_intersect(_grams(F.col("_w"), 3), F.array(*[F.lit(t) for t in every])))
        least = min(len(tri) for _, tri in self.templates) * HELD_BACK
        enough = reduce(lambda a, b: a | b, [_share(F.col("_tri"), F.array(*[F.lit(t) for t in tri])) >= HELD_BACK for _, tri in self.templates])
        return _once(df, **{name: F.when(F.size("_tri") >= least, enough).otherwise(False)}).drop("_w", "_tri")

    def classify(self, paragraphs: DataFrame, text: str) -> DataFrame:
        """Add ``family`` (null: unknown or none), ``score`` and ``template``
        (share of the best template of that family) to paragraphs."""
        df = _with_grams(paragraphs, text)
        df = _once(df, known=F.array_intersect("terms", self.vocabulary))
        df = HashingTF(numFeatures=FEATURES, inputCol="known", outputCol="_v", binary=True).transform(df)
        df = self.model.transform(df)
        p = vector_to_array("_probability")
        df = _once(df, _p=p)
        df = _once(df, score=F.array_max("_p")).withColumn("_k", (F.array_position("_p", F.col("score")) - 1).cast("int"))
        names, need = F.array(*[F.lit(f) for f in self.families]), F.array(*[F.lit(t) for t in self.thresholds])
        guess = F.get(names, F.col("_k"))
        best = F.lit(0.0)
        for f, tri in self.templates:
            best = F.greatest(best, F.when(guess == f, _share(F.col("tri"), F.array(*[F.lit(t) for t in tri]))).otherwise(0.0))
        df = _once(df, template=best)
        sure = (guess != NONE) & (F.col("score") >= F.get(need, F.col("_k"))) & (F.col("template") >= HELD_BACK)
        return _once(df, family=F.when(sure, guess)).drop("w", "terms", "tri", "known", "_v", "_raw", "_probability", "_prediction", "_p", "_k")


def train(documents: DataFrame, negatives: int = NEGATIVES, seed: int = 1) -> Scanner:
    """Train on the templates and about ``negatives`` paragraphs of documents
    chosen by a hash of the row. With no documents there is no ``none`` class."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    templates = _templates(spark).checkpoint()
    known = [(r["family"], r["tri"], r["terms"]) for r in templates.orderBy("template").collect()]       # one row per template
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for _, _, terms in known for t in terms})])
    keep = F.pmod(F.xxhash64(F.lit(seed), "template", "variant", F.col("i")), F.lit(10)) > F.least(F.col("variant"), F.lit(3)) - 1
    made = (templates.select("template", "family", "w", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
            .select("template", "family", "variant", F.posexplode("w").alias("i", "word")).where(keep)
            .groupBy("template", "family", "variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("p"))
            .select("family", "p", F.xxhash64("template", "variant").alias("deal")))
    n = documents.count()
    docs = documents.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 20)) <= int(min(1.0, negatives / 4 / max(1, n)) * (1 << 20)))
    # up to four paragraphs of a chosen document, by hash: a bounded training sample
    lines = F.slice(F.sort_array(F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("p")))), 1, 4)
    # held before the filter below: pushed down, it would evaluate the n-grams once per template
    deal = F.xxhash64("doc_id", "x.h").alias("deal")
    other = _with_grams(docs.select("doc_id", F.explode(lines).alias("x")).select("x.p", deal), "p").select("p", "deal", "tri").checkpoint()
    alike = reduce(lambda a, b: a | b, [_share(F.col("tri"), F.array(*[F.lit(t) for t in tri])) >= 0.3 for _, tri, _ in known])
    rows = made.unionByName(other.where(~alike).select(F.lit(NONE).alias("family"), "p", "deal"))
    families = sorted({f for f, _, _ in known}) + [NONE]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = _with_grams(rows, "p").select(label.cast("double").alias("label"), F.array_intersect("terms", vocabulary).alias("known"),
                                         (F.pmod(F.xxhash64("p"), F.lit(10)) < 3).alias("hold"), "deal").repartition(4, "deal").drop("deal").checkpoint()
    rows = HashingTF(numFeatures=FEATURES, inputCol="known", outputCol="_v", binary=True).transform(rows)
    lr = LogisticRegression(featuresCol="_v", labelCol="label", family="multinomial", regParam=0.001, maxIter=40,
                            probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")
    model = lr.fit(rows.where("NOT hold").select("_v", "label"))
    scored = model.transform(rows.where("hold")).select("label", vector_to_array("_probability").alias("p"))
    scored = scored.withColumn("score", F.array_max("p")).withColumn("k", (F.array_position("p", F.col("score")) - 1).cast("int"))
    bins = (scored.groupBy("k", F.floor(F.col("score") * 50).cast("int").alias("bin"))
            .agg(F.sum((F.col("label") == F.col("k")).cast("int")).alias("yes"), F.count(F.lit(1)).alias("n")).collect())    # at most 51 a family
    thresholds = []
    for k in range(len(families)):
        yes = total = 0
        limit = 0.98
        for r in sorted((r for r in bins if r["k"] == k), key=lambda r: -r["bin"]):
            yes, total = yes + r["yes"], total + r["n"]
            if yes >= PRECISION * total:
                limit = min(limit, r["bin"] / 50)
        thresholds.append(max(limit, 0.3))
    return Scanner(model, families, thresholds, vocabulary, [(f, tri) for f, tri, _ in known])


def _join(w: Column) -> Column:
    return F.array_join(w, " ")


def _stretches(lines: DataFrame) -> DataFrame:
    """``key, line, to, p``: consecutive lines joined, as far as the lines
    between the first and the last have ``SPAN`` words; a line without words
    of its own (``n``) ends them. Only those with an anchor word."""
    following = Window.partitionBy("key").orderBy("line").rowsBetween(1, SPAN + 1)
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("between"), F.col("tail").alias("p"),
                     F.array().cast("array<struct<more:int,p:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        on = acc["on"] & (x["n"] > 0) & (acc["between"] <= SPAN)
        made = F.struct((F.size(acc["out"]) + 1).alias("more"), F.concat_ws(" ", acc["p"], x["head"]).alias("p"))
        return F.struct(on.alias("on"), (acc["between"] + x["n"]).alias("between"), F.when(on, made["p"]).otherwise(acc["p"]).alias("p"),
                        F.when(on, F.concat(acc["out"], F.array(made))).otherwise(acc["out"]).alias("out"))

    df = lines.withColumn("next", F.collect_list(F.struct("n", "head")).over(following)).where("n > 0")
    df = df.select("key", "line", F.explode(F.aggregate("next", start, add, lambda acc: acc["out"])).alias("x"))
    return df.select("key", "line", (F.col("line") + F.col("x.more")).alias("to"), "x.p").where(_has_anchor(F.col("p")))


def scan(documents: DataFrame, scanner: Scanner) -> DataFrame:
    """Per row of ``documents``: ``doc_id, n_licenses`` (confirmed paragraphs),
    ``families`` (sorted, comma-joined), ``paragraphs`` (``line:family`` of
    each, in order, by its first line) and ``n_unknown`` (lines with an anchor
    word that lie in no confirmed paragraph).

    Paragraphs are lines, and stretches of lines with words that were not
    confirmed by themselves; a stretch holds every run of ``SPAN`` words
    across its lines. Of overlapping confirmed stretches the one with the
    largest share of its template wins, then the shorter, then the earlier.

    Null and empty texts have none; repeated rows stay separate.
    """
    d = documents.select("doc_id", "text").withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    lines = d.where(_has_anchor(F.col("text"))).select("key", "text").distinct().select("key", F.posexplode(F.split("text", "\n")).alias("line", "p"))
    sure = F.col("family").isNotNull()
    lines = scanner.plausible(lines.withColumn("anchored", _has_anchor(F.col("p"))), "p", "hold")
    one = scanner.classify(lines.withColumn("a", F.when(F.col("anchored") & F.col("hold"), F.col("p"))), "a")
    one = one.select("key", "line", "anchored", "family", words(F.when(~sure, F.col("p"))).alias("w"))
    one = one.select("key", "line", "anchored", "family", F.size("w").alias("n"), _join(F.slice("w", 1, SPAN)).alias("head"),
                     _join(F.slice("w", F.greatest(F.size("w") - SPAN + 1, F.lit(1)), F.lit(SPAN))).alias("tail"))
    wide = scanner.plausible(_stretches(one), "p", "hold").where("hold").drop("hold")
    wide = scanner.classify(wide, "p").where(sure).select("key", "line", "to", "family", "template")
    rows = one.where(F.col("anchored")).select("key", "line", F.lit(None).cast("int").alias("to"), "family", F.lit(None).cast("double").alias("template")).unionByName(wide)
    alone = F.col("to").isNull()
    got = rows.groupBy("key").agg(      # a text's own lines
        F.collect_list(F.when(alone & sure, F.struct("line", "family"))).alias("s"), F.collect_list(F.when(alone & ~sure, F.col("line"))).alias("u"),
        F.array_sort(F.collect_list(F.when(~alone, F.struct((-F.col("template")).alias("rank"), (F.col("to") - F.col("line")).alias("more"), "line", "to", "family")))).alias("x"))
    got = got.withColumn("x", F.aggregate("x", F.filter("x", lambda x: F.lit(False)), lambda acc, x: F.when(
        F.exists(acc, lambda y: (y["line"] <= x["to"]) & (x["line"] <= y["to"])), acc).otherwise(F.concat(acc, F.array(x)))))
    got = got.withColumn("s", F.array_sort(F.concat("s", F.transform("x", lambda x: F.struct(x["line"].alias("line"), x["family"].alias("family"))))))
    got = got.select(
        "key", F.size("s").cast("bigint").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform("s", lambda x: x["family"]))), ",").alias("f"),
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ",").alias("l"),
        F.size(F.filter("u", lambda i: ~F.exists("x", lambda x: i.between(x["line"], x["to"])))).cast("bigint").alias("u"))
    zero = F.lit(0).cast("bigint")
    return salted_left_join(d.select("doc_id", "key"), got, "key", "doc_id").select(
        "doc_id", F.coalesce("n", zero).alias("n_licenses"), F.coalesce("f", F.lit("")).alias("families"),
        F.coalesce("l", F.lit("")).alias("paragraphs"), F.coalesce("u", zero).alias("n_unknown"))
