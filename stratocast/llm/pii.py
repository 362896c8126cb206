"""Personal data: candidate spans scored by boosted trees, DataFrame functions only.

Four base rules (email, ip, card, phone) always count. High-recall generators
propose further, overlapping spans (obfuscated addresses, bare numbers); Spark
ML's boosted trees, trained here, score them from format and context; the
trees become column expressions, and a proposal is taken when its score
reaches the threshold calibrated for its kind.

Training needs no labels and reads all documents: base spans and
rewritten forms of them (without ``+``, with ``[at]``, dotted ...) are
positive. Negative are base spans proposed as the wrong kind, spoilt copies of
them, and proposals outside base spans that fail their kind's format or follow
a word for other numbers (order, version ...). Other proposals outside base
spans may be personal data: they have no label, in fit and calibration alike.
A held-out part sets, per kind, the lowest threshold at which the precision
reaches ``PRECISION``.

Scale: one pass without a shuffle to train (but for counts of equal
proposals) and one to find. Spans live in arrays inside their row, so
no row key is needed and repeated ids cannot mix; every pattern is linear in
the text (possessive runs that start only at a run's border).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.llm.spans import add_spans, markable
from stratocast.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone")
TRAINING_PARTS = 16
ROUNDS, DEPTH = 12, 3
PRECISION = 0.98
CONTEXT = 24

_LOCAL = "[A-Za-z0-9._%+-]"
# the base rules; \G continues where the last match of the same rule ended
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|[(\[{]at[)\]}])", r"(?:\.|[(\[{]dot[)\]}])"
GENERATORS = {
    # name@host, name [at] host [dot] tld, name at host dot tld
    "address": rf"(?<!{_LOCAL}){_LOCAL}++(?:\x20?{_AT}\x20?[A-Za-z0-9-]++(?:\x20?{_DOT}\x20?[A-Za-z0-9-]++|\x20dot\x20[A-Za-z0-9-]++)*+"
               r"|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "dotted": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|[(\[{]\.[)\]}]|[(\[{]dot[)\]}])\x20?[0-9]{1,3}){3}(?![0-9.])",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\x2F-]{0,2}[0-9])++(?![0-9A-Za-z])",
}
PROPOSES = {"address": ("email",), "dotted": ("ip",), "number": ("card", "phone")}
CUES = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|pay",
        "phone": "phone|tel|call|fax|mobile|cell|dial"}

# what comes right before a number that is no personal data
OTHER = (r"(?i)(?:(?<![a-z])(?:order|invoice|ticket|article|serial|batch|build|version|release|revision|section|chapter|isbn|issn|sku|doi|ver|rev|v)"
         r"(?:\x20?(?:number|code|num|no|nr|id))?[\x20.:#=]{0,3}|[#$\u20ac\u00a3]\x20?)\z")
# dates, ranges of years and decimal fractions
_NO_PHONE = (r"\A(?:(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9](?:\x20[0-9]{1,2})?|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2}"
             r"|(?:1[0-9]|20)[0-9]{2}\x20?[-/]\x20?(?:1[0-9]|20)[0-9]{2}|[0-9]\.[0-9]+)\z")

_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _plausible(kind: str, value: Column) -> Column:
    """Whether a proposal, its rewriting undone, has its kind's format."""
    plain = F.regexp_replace(value, r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20|\x20?@\x20?", "@")
    plain = F.regexp_replace(plain, r"\x20?[(\[{](?:dot|\.)[)\]}]\x20?|\x20dot\x20|\x20?\.\x20?", ".")
    if kind == "email":
        return plain.rlike(r"\A[^@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\z")
    if kind == "phone":                     # without its country code, and in at most six groups
        return F.length(_digits(value)).between(7, 15) & ~value.rlike(_NO_PHONE) & ~value.rlike(r"(?:[0-9]+[^0-9]+){6}[0-9]")
    return _valid(kind, plain)


def _no_pii(kind: str, value: Column, before: Column) -> Column:
    """Whether a proposal is surely no personal data of this kind."""
    return ~_plausible(kind, value) | (before.rlike(OTHER) if kind != "email" else F.lit(False))


def features(kind: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """Format and context features of one proposal, as doubles."""
    d = _digits(value)
    count = lambda chars: F.length(value) - F.length(F.regexp_replace(value, chars, ""))      # noqa: E731
    groups = F.split(F.regexp_replace(value, "[^0-9]+", " "), " ")
    yes = [
        *[kind == i for i in range(len(KINDS))],
        value.contains("+"), value.contains("("), value.contains("@"), value.rlike(r"\b(?:at|dot)\b"),
        value.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), value.rlike(r"\.[A-Za-z]{2,6}\z|dot[)\]}]?\x20?[A-Za-z]{2,6}\z"),
        F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", F.when(F.length(d).between(13, 19), d).otherwise("1")), F.lit(False)),
        F.regexp_replace(value, r"[^0-9.]|[(\[{]dot[)\]}]", "").rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z"),
        before.rlike(r"[A-Za-z0-9]\z"), after.rlike(r"\A[A-Za-z0-9]"), before.rlike(r"[=\"'#/]\x20?\z"),
        *[F.lower(before).rlike(CUES[k]) for k in KINDS],
    ]
    # the digits of an address say nothing, but would tell a few names from others
    own = lambda c: F.when(kind == 0, 0).otherwise(c)       # noqa: E731
    numbers = [F.length(value), own(F.length(d)), count("[0-9A-Za-z]"), count("[A-Za-z]"), count(r"\."), count(r"[^\x20]"),
               *map(own, (F.size(groups), F.length(F.get(groups, F.lit(0))), F.length(F.element_at(groups, -1)),
                          F.size(F.array_distinct(F.split(d, "")))))]
    return [c.cast("double") for c in (*yes, *numbers, before.rlike(OTHER))]


def _rule(kind: str):
    return lambda m: _valid(kind, m["value"])


def _as_span(kind: int):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def _as_proposal(kind: int):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                              F.array(*features(F.lit(kind), m["value"], m["before"], m["after"])).alias("x"))


def _found(documents: DataFrame) -> DataFrame:
    """Add ``base`` (kind, start, end of valid base spans, in order), per-kind
    match arrays ``b_<kind>`` and generator arrays ``g_<name>``."""
    df = documents.withColumn("_t", markable(F.col("text")))
    for k, pattern in BASE.items():
        df = add_spans(df, "_t", pattern, f"m_{k}", CONTEXT)
        df = df.withColumn(f"b_{k}", F.filter(f"m_{k}", _rule(k))).drop(f"m_{k}")
    for g, pattern in GENERATORS.items():
        df = add_spans(df, "_t", pattern, f"g_{g}", CONTEXT)
    # a bare number of fewer digits is no card or phone
    df = df.withColumn("g_number", F.filter("g_number", lambda m: F.length(_digits(m["value"])) >= 7))
    base = F.concat(*[F.transform(f"b_{k}", _as_span(i)) for i, k in enumerate(KINDS)])
    return df.withColumn("base", base.cast(_SPAN)).drop("_t")


def _overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"]))


# rewritten forms of base spans: (from, to) applied in turn; fixed values
_REWRITES = {
    "email": ((("@", " [at] "), (r"\.", " [dot] ")), (("@", " at "), (r"\.", " dot ")), (("@", "(at)"),)),
    "ip": (((r"\.", "[.]"),), ((r"\.", " . "),)),
    "card": ((("(?<=[0-9]{4})[ -]?(?=[0-9])", "."),), (("[ -]", ""), ("([0-9]{4})(?=[0-9])", "$1/"))),
    "phone": (((r"\A\+", ""),), ((r"\A\+[0-9]{1,3}[ .-]?(?=[(0-9])", ""),)),
}


def _spoilt(kind: str, value: Column, before: Column) -> tuple[Column, Column]:
    """A base span's value and context, changed so that it is no personal data."""
    if kind == "email":
        host = F.translate(F.substring_index(value, "@", -1), ".", "-")
        return F.concat(F.substring_index(value, "@", 1), F.lit("@"), host), before
    if kind == "card":                      # its check digit, one higher
        return F.concat(F.expr("substring(value, 1, length(value) - 1)"), F.translate(F.right(value, F.lit(1)), "0123456789", "1234567890")), before
    if kind == "ip":
        return value, F.lit("version ")
    return F.regexp_replace(value, r"\A\+", ""), F.lit("order number ")


def _training_rows(found: DataFrame) -> DataFrame:
    """``kind, value, before, after, label`` of all found documents."""
    parts = []
    wrong = {"card": 3, "phone": 2}
    for i, k in enumerate(KINDS):
        base = found.select(F.explode(f"b_{k}").alias("m")).select("m.value", "m.before", "m.after")
        forms = [F.col("value")] + [reduce(lambda v, s: F.regexp_replace(v, s[0], s[1]), steps, F.col("value")) for steps in _REWRITES[k]]
        parts.append(base.select(F.lit(i).alias("kind"), F.explode(F.array(*forms)).alias("value"), "before", "after", F.lit(1.0).alias("label")))
        spoilt, context = _spoilt(k, F.col("value"), F.col("before"))
        parts.append(base.select(F.lit(i).alias("kind"), spoilt.alias("value"), context.alias("before"), "after", F.lit(0.0).alias("label")))
        if k in wrong:                      # the same number proposed as the other kind
            parts.append(base.select(F.lit(wrong[k]).alias("kind"), "value", "before", "after", F.lit(0.0).alias("label")))
    for g, kinds in PROPOSES.items():
        free = found.select(F.explode(F.filter(f"g_{g}", lambda m: ~_overlaps(m, F.col("base")))).alias("m"))
        for k in kinds:
            sure = free.where(_no_pii(k, F.col("m.value"), F.col("m.before")))
            parts.append(sure.select(F.lit(KINDS.index(k)).alias("kind"), "m.value", "m.before", "m.after", F.lit(0.0).alias("label")))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Model:
    """Boosted trees as nested tuples and a threshold for each kind."""

    trees: list[tuple[float, object]]
    thresholds: list[float]

    def score(self, x: Column) -> Column:
        """Probability for an array column of features."""
        def column(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(F.get(x, F.lit(feature)) <= limit, column(low)).otherwise(column(high))

        margin = reduce(lambda a, b: a + b, [F.lit(w) * column(t) for w, t in self.trees])
        return 1 / (1 + F.exp(-2 * margin))


def _parse(lines: list[str]) -> object:
    """One tree of Spark's ``toDebugString`` as ``(feature, limit, low, high)`` or a leaf."""
    line = lines.pop(0)
    if m := re.search(r"Predict: (\S+)", line):
        return float(m[1])
    m = re.search(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _parse(lines)
    lines.pop(0)                            # the Else line
    return int(m[1]), float(m[2]), low, _parse(lines)


def train(documents: DataFrame, seed: int = 1) -> Model | None:
    """Fit on all ``documents`` (column ``text``); None when they lack either class.

    Proposals with the same features, label and part are one row with their
    number as its weight, so the learner's table grows with the kinds of
    proposals, not with their copies.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    found = _found(documents.select("text")).select("base", *[f"b_{k}" for k in KINDS], *[f"g_{g}" for g in GENERATORS])
    rows = _training_rows(found.checkpoint())
    rows = rows.select("kind", "label", F.array(*features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))).alias("x"),
                       (F.pmod(F.xxhash64("kind", "value", "before"), F.lit(10)) < 3).alias("hold"))
    same = ["kind", "label", "hold", "x"]
    rows = rows.groupBy(*same).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = rows.repartition(TRAINING_PARTS, F.xxhash64("x")).sortWithinPartitions(*same).checkpoint()
    if {r["label"] for r in rows.where("NOT hold").select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    gbt = GBTClassifier(featuresCol="v", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=seed, weightCol="n")
    fitted = gbt.fit(rows.where("NOT hold").select(array_to_vector("x").alias("v"), "label", "n"))
    trees = [(w, _parse(t.toDebugString.splitlines()[1:])) for w, t in zip(fitted.treeWeights, fitted.trees)]
    model = Model(trees, [2.0] * len(KINDS))
    # counts per kind and score in steps of 0.01: at most 404 rows
    bins = (rows.where("hold").select("kind", "label", "n", F.floor(model.score(F.col("x")) * 100).cast("int").alias("bin"))
            .groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("yes"), F.sum("n").alias("n")).collect())
    for k in range(len(KINDS)):
        yes = total = 0.0
        for r in sorted((r for r in bins if r["kind"] == k), key=lambda r: -r["bin"]):
            yes, total = yes + r["yes"], total + r["n"]
            if r["bin"] >= 50 and yes >= PRECISION * total:
                model.thresholds[k] = r["bin"] / 100
    return model


def find_pii(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``: arrays of ``kind`` (0-3 as in ``KINDS``),
    ``start, end`` in kind and start order; ``spans`` also holds the accepted
    proposals. All columns are kept.

    A null text has no spans. Accepted proposals never overlap a base span;
    of overlapping proposals the best score wins, then the longer, then the
    earlier, then the first kind.
    """
    keep = documents.columns
    df = documents.withColumnRenamed(text, "text") if text != "text" else documents
    df = _found(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col("text")))
    if model is None:
        df = df.withColumn("spans", F.col("base"))
    else:
        proposals = F.concat(*[F.transform(f"g_{g}", _as_proposal(KINDS.index(k))) for g, kinds in PROPOSES.items() for k in kinds])
        df = df.withColumn("_p", F.filter(proposals, lambda p: ~_overlaps(p, F.col("base"))))
        df = df.withColumn("_p", F.transform("_p", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
                                                                      model.score(p["x"]).alias("score"))))
        need = F.array(*[F.lit(t) for t in model.thresholds])
        df = df.withColumn("_p", F.filter("_p", lambda p: p["score"] >= F.get(need, p["kind"])))
        rank = lambda p: F.struct(p["score"], p["end"] - p["start"], -p["start"], -p["kind"])      # noqa: E731
        df = df.withColumn("_best", F.filter("_p", lambda p: ~F.exists("_p", lambda q: (
            (q["start"] < p["end"]) & (p["start"] < q["end"]) & (rank(q) > rank(p))))))
        df = df.withColumn("spans", F.array_sort(F.concat("base", F.transform("_best", lambda p: F.struct(
            p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))).cast(_SPAN))))
    return df.select(*[F.col("_row").getField(c).alias(c) for c in keep if c not in ("base", "spans")], "base", "spans")


def span_text(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> Column:
    """The text with every stretch covered by spans replaced by ``[KIND]`` of
    the first span in it; texts without spans stay as they are (null too)."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    merged = F.aggregate(
        by_start, F.array().cast("array<struct<start:int,end:int,kind:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                             F.element_at(acc, -1)["kind"].alias("kind")))))
        .otherwise(F.concat(acc, F.array(s))))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text)
    out = F.aggregate(
        merged, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]),
                                                                                F.get(tags, s["kind"]))).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    return F.when(F.size(spans) > 0, out).otherwise(t)
