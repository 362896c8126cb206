import hashlib

from pyspark.sql import functions as F

from stratocast.llm import fixity as X

PAGES = "page_id bigint, url string, html string"


def pages(spark, n=600):
    return spark.createDataFrame([(i, f"http://h{i % 3}/", "x" * (i * 37 % 900) + "é") for i in range(n)] + [(None, None, None), (None, None, None)], PAGES)


def read(manifest, edit):
    return manifest.select("page_id", "segment", "offset", *edit)


def test_records_lie_gapless(spark):
    rows = X.manifest(pages(spark), 100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.segment, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    body = pages(spark).where("page_id = 5").select(X.warc_record(F.col("page_id"), F.col("url"), F.col("html"))).first()[0]
    mine = next(r for r in rows if r.page_id == 5)
    assert hashlib.sha256(body).hexdigest() == mine.digest and len(body) == mine.length and body.endswith("xé\r\n\r\n".encode())


def test_every_kind_of_damage_is_found_and_nothing_else(spark):
    m = X.manifest(pages(spark), 100).checkpoint()
    bad = F.when(F.col("page_id") % 71 == 3, F.lit("0" * 64)).otherwise(F.col("digest")).alias("digest")
    size = F.when(F.col("page_id") % 71 == 4, F.col("length") - 1).otherwise(F.col("length")).alias("length")
    digest = F.when(F.col("page_id") % 71 == 4, F.lit("1" * 64)).otherwise(bad).alias("digest")
    extra = m.where("page_id = 7").withColumn("offset", F.lit(10**7).cast("bigint"))
    replica = read(m, [size, digest]).where("page_id IS NULL OR page_id % 71 != 5").unionByName(extra)
    for range_bytes, fan in ((1 << 16, 16), (300, 2), (1, 3)):
        got = {(r.page_id, r.status) for r in X.audit(m, replica, range_bytes, fan).collect()}
        want = {(i, "changed") for i in range(3, 600, 71)} | {(i, "resized") for i in range(4, 600, 71)} | {(i, "missing") for i in range(5, 600, 71)} | {(7, "extra")}
        assert got == want
    assert X.audit(m, m).isEmpty()


def test_lost_segments_repeated_rows_and_empty_tables(spark):
    m = X.manifest(pages(spark, 120), 50).checkpoint()
    assert X.audit(m, m.where("segment = 0")).where("status != 'missing'").isEmpty()
    assert X.audit(m, m.where("segment = 0")).count() == 72
    assert X.audit(m, m.unionByName(m.where("page_id = 3"))).count() == 1
    none = m.limit(0)
    assert X.audit(none, none).isEmpty() and X.audit(none, m).where("status != 'extra'").isEmpty()


def test_roots_agree_only_for_equal_replicas(spark):
    m = X.manifest(pages(spark, 90), 50).checkpoint()
    a, b = (X.tree(t, 2, 500, 4)[-1] for t in (m, m.withColumn("digest", F.when(F.col("page_id") == 60, "f").otherwise(F.col("digest")))))
    assert {r.segment for r in a.exceptAll(b).collect()} == {1}
