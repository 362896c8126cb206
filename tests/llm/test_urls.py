import random
import re
import time
from itertools import combinations, product

from pyspark.sql import functions as F

from stratocast.llm import catalog
from stratocast.llm import urls as U

from conftest import SF_SMALL


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), v, h + p) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[2], best[1]


URLS = [None, "", "no scheme.org/", "http://org/", "http://ORG/x", "http://a.org", "http://borg/", "https://x.Example.org/es/1?u#f", "http://example.org/en/12",
        "http://example.org/en/2", "a://b://c.com/de/", "http://É.com/fr/", "http://user@h.com:80/de/x", "//x.org/", "http://", "http:///de/", "http://x.com/fr",
        "http://x.com?/fr/", "http://x.net/es/", "HTTP://a.com/de/?q=http://b.org/", "http://a\nb.org/\nx", "http://x.org/" + "a" * 100_000]


def test_rules_by_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn("host", F.lit("own")).withColumn("items", F.lit("own"))
    rows = U.judge(pages).orderBy("page_id").collect()
    for r, u in zip(rows, URLS):
        host, path, rule, verdict = brute(u)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert len(rows) == len(URLS)


def test_whole_table_and_empty_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule) for r in catalog.op7_urls(spark, SF_SMALL).collect()}
    assert got == {r.page_id: brute(r.url)[:3] for r in pages.collect()}
    assert U.judge(pages.limit(0)).count() == 0


def brute_rules(rows, support, confidence):
    """Minimal sure rules by counting every combination."""
    n, sets, both = len(rows), {}, {}
    for items, label in rows:
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                sets[c] = sets.get(c, 0) + 1
                both[c, label] = both.get((c, label), 0) + 1
    sure = {(c, label): k / sets[c] for (c, label), k in both.items() if k >= support * n and k / sets[c] >= confidence}
    return {(frozenset(c), label) for (c, label), p in sure.items()
            if not any(sure.get((s, label), 0) >= p for k in range(1, len(c)) for s in combinations(c, k))}


def spelled_out(model):
    """Rules with every choice of tokens that stand for each other."""
    names = {}
    for t, a in model.alias.items():
        names.setdefault(a, []).append(t)
    return {(frozenset(c), r[1]) for rules in model.index.values() for r in rules for c in product(*[names[t] for t in r[0]])}


def mine(spark, rows, *limits):
    return U.mine(spark.createDataFrame(rows, "items array<string>, label string"), *limits)


def test_mined_rules_by_brute_force(spark):
    rows = [([f"a{i % 3}", f"b{i % 4}", "all", f"c{i % 5}"], "block" if i % 3 == 1 and i % 4 < 2 else "allow") for i in range(240)]
    model = mine(spark, rows + [(None, "allow"), (["a0"], None)], 0.05, 0.9)
    assert spelled_out(model) == brute_rules(rows, 0.05, 0.9)
    assert all(t in r[0] for t, rules in model.index.items() for r in rules)
    assert model.judge(["a1", "b1", "zz"])[0] == "block" and model.judge(["a2", "b1"])[0] == "allow" and model.judge(["zz"]) == (None, None, None)
    assert model.judge(None) == (None, None, None)


def test_random_sets_with_long_rules_and_shared_tokens(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        items = {t for t in "abcdefg" if rng.random() < 0.7}
        # x, y and z always occur together; the label needs four tokens
        rows.append((sorted(items | (set("xyz") if "a" in items and rng.random() < 0.8 else set())), "block" if set("abcd") <= items else "allow"))
    model = mine(spark, rows, 0.02, 0.99)
    assert spelled_out(model) == brute_rules(rows, 0.02, 0.99)
    assert max(len(r[0]) for rules in model.index.values() for r in rules) >= 4 and model.alias["z"] == "x"
    for items, _ in rows[:40]:
        fits = [(len(c), label) for c, label in brute_rules(rows, 0.02, 0.99) if c <= set(items)]
        assert (model.judge(items)[0] is None) == (not fits)


def test_tokens_in_nearly_all_labels_still_make_rules(spark):
    urls = [f"http://spam{'' if i % 20 else 'less'}.com/de/{i}" for i in range(200)] + ["http://spam.net/x"]
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).where("page_id = 200").first()
    assert got.verdict == "block"


def test_many_segments_in_common(spark):
    deep = "/".join(f"s{k}" for k in range(40))
    urls = [f"http://x.com/{'de' if i % 2 else 'fr'}/{deep}/{i}" if i < 20 else f"http://h{i}.org/{i}" for i in range(400)]
    urls += [f"http://y.net/{deep}", "http://y.net/s3"]
    t = time.time()
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).orderBy("page_id").collect()
    assert time.time() - t < 60 and len(got) == 402 and {r.verdict for r in got[-2:]} <= {"allow", "block"}


def test_deep_path_segments_are_mined_and_matched(spark):
    urls = [f"http://{'x.com/de' if i % 2 else 'x.com/fr'}/{i % 7}a/{i % 5}b/{i % 3}c/{'casino' if i % 2 else 'news'}/{i}.html" for i in range(200)]
    urls += ["http://y.net/a/b/c/d/e/casino/x", "http://y.net/a/b/c/d/e/f/x"]
    got = [(r.verdict, r.mined_rule) for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).orderBy("page_id").collect()[-2:]]
    assert got[0] == ("block", "path:casino") and got[1] == ("allow", None)


def test_nothing_to_mine(spark):
    assert U.mine(spark.createDataFrame([], "items array<string>, label string")).index == {}
