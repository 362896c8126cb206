import re

import numpy as np
import xxhash

from stratocast.llm import simhash as S
from stratocast.llm.components import connected_components

from llm_fixtures import docs  # noqa: F401


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius=2):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints_and_components_by_brute_force(spark, docs):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [None, "", " \t", "One", "ONE two", "é one\x85two three", base, base.upper(), base + " x", base[:-5], base, "y " * 50_000]
    rows = S.near_duplicates(docs(texts)).orderBy("doc_id").collect()
    prints = [brute_print(t) for t in texts]
    assert [int(r.fingerprint, 16) for r in rows] == prints
    assert [r.component_id for r in rows] == brute_components(prints)


def test_links_of_planted_bits(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(25):                    # a cloud around each centre, in chains
            bits = rng.choice(64, size=rng.integers(1, 4), replace=False)
            values.add(c ^ sum(1 << int(b) for b in bits))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed] + [(None,)], "fp bigint").repartition(3)
    comp = {r.node: r.root for r in connected_components(S.links(fps)).collect()}
    mine = [comp.get(v, v) for v in signed]
    want = brute_components(values)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_repeated_and_null_ids_and_empty_table(spark, docs):
    d = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "other words here"), (None, "alone it is"), (None, None)], "doc_id bigint, text string")
    rows = {(r.doc_id, r.key): r.component_id for r in S.near_duplicates(d).collect()}
    assert len(rows) == 5 and sorted(map(str, rows.values())) == ["7", "7", "7", "None", "None"]
    assert S.near_duplicates(docs([])).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}
