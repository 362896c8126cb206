"""URL filtering: fixed rules first, then association rules mined from labels.

FP-growth (Spark ML) finds frequent combinations of URL tokens among labelled
pages, the label being one more token. Rules "tokens => label" survive if
their support and confidence suffice and no shorter rule with a subset of the
tokens says the same at least as surely. A URL is matched through an inverted
index: each rule is filed under its rarest token, so only rules filed under
the URL's own tokens are tested.

Scale: mining runs on the executors, over tokens that are mined once for all
that occur in the same URLs; the number of rules depends on the support, not on
the pages. Matching is one pass without a shuffle over a broadcast index.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# (verdict, host, path): fixed values
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
SUPPORT, CONFIDENCE = 0.01, 0.9
MOST_RULES = 2_000_000      # more are refused, before anything reaches the driver


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty for null or without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(u, pattern, 2)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its verdict (null if none).

    A rule fits its host and all subdomains if the path starts with its path;
    of equally long rules a block comes first.
    """
    name = verdict = F.lit(None).cast("string")
    # the shortest first: a later, longer one takes precedence over it
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: top-level domain, host labels and their parts, path
    segments (numbers as ``#``; the first three by position, deeper ones
    without), file ending, query keys, scheme."""
    def tagged(tag: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(tag), v))

    labels = F.split(host, r"\.")
    plain = F.regexp_replace(path, r"[0-9]+", "#")
    segments = F.split(plain, "/")
    bare = lambda v: F.regexp_replace(v, r"\.[a-z]+\z", "")      # noqa: E731
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("tld:"), F.coalesce(F.element_at(labels, -1), F.lit("")))),
        tagged("host:", F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))),
        tagged("part:", F.filter(F.split(host, r"[.-]"), lambda v: F.length(v) > 2)),
        F.transform(F.slice(segments, 2, 3), lambda v, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), bare(v))),
        tagged("path:", F.transform(F.slice(segments, F.lit(5), F.size(segments)), bare)),
        tagged("ends:", F.array(F.regexp_extract(path, r"\.([a-z]+)\z", 1))),
        tagged("query:", F.transform(F.split(query, "&"), lambda v: F.regexp_extract(v, r"\A([^=]*)", 1))),
        tagged("scheme:", F.array(F.regexp_extract(url, r"\A([A-Za-z]+)://", 1)))))


@dataclass
class Rules:
    """Mined rules by their rarest token: ``(tokens, verdict, confidence, support)``.

    ``alias``: tokens that occur in the very same labelled URLs stand for each
    other; each names the one that rules are written with.
    """

    index: dict[str, list[tuple[frozenset, str, float, float]]]
    alias: dict[str, str]

    def judge(self, items: list[str] | None) -> tuple[str | None, str | None, float | None]:
        """Verdict, rule (the URL's tokens that fit it, joined by ``+``) and
        confidence of the surest rule whose tokens all occur; then the better
        supported, the longer."""
        have, best = {}, None
        for t in sorted(items or ()):
            have.setdefault(self.alias.get(t, t), t)
        for t in have:
            for r in self.index.get(t, ()):
                if r[0] <= have.keys():
                    key = (r[2], r[3], len(r[0]), r[1] == "block", sorted(r[0]))
                    best = max(best, (key, r)) if best and best[0] != key else best or (key, r)
        if best is None:
            return None, None, None
        return best[1][1], "+".join(sorted(have[t] for t in best[1][0])), best[1][2]


def _classes(data: DataFrame, least: float) -> tuple[dict[str, str], dict[str, int]]:
    """Of the tokens in at least ``least`` URLs: the smallest with the very same
    URLs, and the number of URLs of each such token. At most (tokens per URL) /
    support tokens reach the driver."""
    row = data.select("items", F.xxhash64("items", "label").alias("a"), F.xxhash64("label", "items").alias("b"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))       # noqa: E731
    tokens = (row.select(F.explode("items").alias("t"), "a", "b").groupBy("t").agg(F.count(F.lit(1)).alias("n"), wide("a").alias("a"), wide("b").alias("b"))
              .where(F.col("n") >= least))
    alias, frequency, first = {}, {}, {}
    for r in sorted(tokens.collect(), key=lambda r: r["t"]):
        alias[r["t"]] = first.setdefault((r["n"], r["a"], r["b"]), r["t"])
        frequency[alias[r["t"]]] = r["n"]
    return alias, frequency


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> Rules:
    """Mine rules from ``items`` (distinct tokens) and ``label``; rows with a
    null in either are ignored. An empty table gives no rules.

    Tokens of the very same URLs are mined as one: any combination of them
    says what one says, and there would be two to the power of their number.
    A rule is dropped if one with fewer of its tokens is at least as sure.
    """
    data = labelled.select(F.array_sort(F.array_distinct("items")).alias("items"), "label").where("items IS NOT NULL AND label IS NOT NULL")
    n = data.count()
    if not n:
        return Rules({}, {})
    alias, frequency = _classes(data, support * n)
    if not frequency:
        return Rules({}, {})
    vocabulary = F.array(*[F.lit(t) for t in sorted(frequency)])
    sets = data.select(F.concat(F.array_intersect("items", vocabulary), F.array(F.concat(F.lit("="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(sets)
    found = (model.associationRules
             .where(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("=")))
             .select("antecedent", F.substring(F.element_at("consequent", 1), 2, 1 << 20).alias("label"), "confidence", "support").checkpoint())
    many = found.count()
    if many > MOST_RULES:
        raise ValueError(f"{many} rules: raise the support ({support}) or the confidence ({confidence})")
    rules = sorted((len(r["antecedent"]), sorted(r["antecedent"]), r["label"], r["confidence"], r["support"]) for r in found.collect())
    index = defaultdict(list)
    for _, items, label, conf, supp in rules:           # shorter ones first
        have = frozenset(items)
        if not any(r[0] < have and r[1] == label and r[2] >= conf for t in items for r in index.get(t, ())):
            index[min(items, key=lambda t: (frequency[t], t))].append((have, label, conf, supp))
    return Rules(dict(index), alias)


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and, for pages that no fixed rule
    fits, ``mined_rule`` and ``confidence`` of the mined rule that decided
    (null: none fitted, the verdict is ``allow``).

    The pages that a fixed rule decides are the labels. A null URL has an
    empty host and path and is allowed; repeated rows stay.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("given", verdict)
    base = base.withColumn("items", F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path"))))
    mined = mine(base.select("items", F.col("given").alias("label")), support, confidence)
    shared = pages.sparkSession.sparkContext.broadcast(mined)
    rows = base.select("page_id", "host", "path", "rule", "given", "items")
    schema = StructType([f for f in rows.schema.fields if f.name not in ("given", "items")]
                        + [StructField("verdict", StringType()), StructField("mined_rule", StringType()), StructField("confidence", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [(g, None, None) if g is not None else model.judge(i) for g, i in zip(b.column("given").to_pylist(), b.column("items").to_pylist())]
            verdicts, names, sure = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array([v or DEFAULT for v in verdicts], pa.string()),
                 pa.array(names, pa.string()), pa.array(sure, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
