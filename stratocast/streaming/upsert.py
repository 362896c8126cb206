"""Stream sinks that are exactly-once by batch id.

``UpsertTable`` keeps the newest row of each key (latest gauges, running
histograms): what update-mode streams need and file sinks cannot take.
``BatchSides`` appends several outputs of one micro-batch together.

Both write a batch's data into folders named after the batch, then one commit
record. A replay of a committed batch does nothing; a crash before the record
leaves data that no reader sees and that the replay overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.commits import commit, delete, read_record, record_names

BUCKETS = 16


def _name(batch_id: int) -> str:
    return f"{batch_id:020d}"


class UpsertTable:
    """A table with one row per ``keys``, in a folder.

    Rows lie in ``buckets`` buckets by a hash of the key. A batch rewrites only
    the buckets it touches; a commit record says which batch wrote the current
    files of each bucket, so readers see whole batches. ``newest`` (a column)
    decides between rows of one key; without it the later batch wins. The
    number of buckets belongs to the folder: take about one per 100 MB.
    """

    def __init__(self, path: str, schema: T.StructType | str, keys: Sequence[str], newest: Sequence[str] = (), buckets: int = BUCKETS):
        self.path, self.keys, self.newest, self.buckets = path.rstrip("/"), list(keys), list(newest), buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _commits(self) -> str:
        return f"{self.path}/_commits"

    def _current(self, spark: SparkSession) -> tuple[int, dict[str, int]]:
        """The last committed batch and, per bucket, the batch that wrote it."""
        names = record_names(spark, self._commits())
        if not names:
            return -1, {}
        record = read_record(spark, f"{self._commits()}/{names[-1]}")
        if record["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {record['buckets']} buckets, not {self.buckets}")
        return int(names[-1]), record["files"]

    def _files(self, files: Mapping[str, int], only: Sequence[int] | None = None) -> list[str]:
        return [f"{self.path}/batch={b}/_bucket={k}" for k, b in sorted(files.items()) if only is None or int(k) in only]

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows after the last committed batch."""
        return self._read(spark, self._files(self._current(spark)[1]))

    def upsert(self, batch: DataFrame, batch_id: int) -> bool:
        """Merge a batch (for ``foreachBatch``); False for a replay."""
        spark = batch.sparkSession
        last, files = self._current(spark)
        if batch_id <= last:
            return False
        names = [f.name for f in self.schema.fields]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(*names, F.lit(1).alias("_later"), bucket.alias("_bucket")).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]        # at most ``buckets`` numbers
            old = self._read(spark, self._files(files, touched)).select(*names, F.lit(0).alias("_later"), bucket.alias("_bucket"))
            order = F.struct(*[F.col(c) for c in self.newest], F.col("_later"), *[F.col(c) for c in names if c not in self.keys and c not in self.newest])
            rest = [c for c in names if c not in self.keys]
            best = old.unionByName(new).groupBy("_bucket", *self.keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
            best = best.select("_bucket", *[F.col("_row").getField(c).alias(c) if c in rest else F.col(c) for c in names])
            (best.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/batch={batch_id}"))
        finally:
            new.unpersist()
        return commit(spark, f"{self._commits()}/{_name(batch_id)}",
                      {"buckets": self.buckets, "files": {**files, **{str(k): batch_id for k in touched}}})


    def clean(self, spark: SparkSession) -> int:
        """Delete what the last committed batch no longer names (older files,
        older records); readers must not be older than that batch. Returns the
        number of deleted folders and records."""
        last, files = self._current(spark)
        used, n = set(self._files(files)), 0
        for batch in record_names(spark, self.path):
            for bucket in record_names(spark, f"{self.path}/{batch}", hidden=True):
                folder = f"{self.path}/{batch}/{bucket}"
                if batch.startswith("batch=") and int(batch[6:]) <= last and folder not in used:
                    delete(spark, folder)
                    n += 1
        for name in record_names(spark, self._commits())[:-1]:
            delete(spark, f"{self._commits()}/{name}")
            n += 1
        return n


class BatchSides:
    """Append-only outputs that one micro-batch writes together.

    ``folders`` names the folder of each side; a batch's rows of a side lie in
    ``<folder>/batch=<id>``. They count once ``commits`` holds the batch's record.
    """

    def __init__(self, folders: Mapping[str, str], commits: str, format: str = "json", options: Mapping[str, str] | None = None):
        self.folders = {k: v.rstrip("/") for k, v in folders.items()}
        self.commits, self.format, self.options = commits.rstrip("/"), format, dict(options or {})

    def committed(self, spark: SparkSession) -> list[int]:
        return [int(n) for n in record_names(spark, self.commits)]

    def write(self, sides: Mapping[str, DataFrame], batch_id: int) -> bool:
        """Write all sides, then the record; False for a replay."""
        spark = next(iter(sides.values())).sparkSession
        if read_record(spark, f"{self.commits}/{_name(batch_id)}") is not None:
            return False
        for name, rows in sides.items():
            rows.write.format(self.format).options(**self.options).mode("overwrite").save(f"{self.folders[name]}/batch={batch_id}")
        return commit(spark, f"{self.commits}/{_name(batch_id)}", {"batch": batch_id, "sides": sorted(sides)})

    def read(self, spark: SparkSession, side: str, schema: T.StructType | str) -> DataFrame:
        """Rows of all committed batches of a side."""
        done = self.committed(spark)
        if not done:
            return spark.createDataFrame([], schema)
        paths = [f"{self.folders[side]}/batch={b}" for b in done]
        return spark.read.format(self.format).options(**self.options).schema(schema).load(paths)


def upsert_stream(stream: DataFrame, table: UpsertTable, checkpoint: str, trigger: dict | None = None):
    """Writer of an update-mode stream into an upsert table (``start()`` it)."""
    w = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id) and None))
    return w.trigger(**trigger) if trigger else w


def sides_stream(stream: DataFrame, split: Callable[[DataFrame], Mapping[str, DataFrame]], sink: BatchSides, checkpoint: str,
                 trigger: dict | None = None):
    """Writer that reads each micro-batch once, splits it and writes all sides."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sink.write(split(batch), batch_id)
        finally:
            batch.unpersist()

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return w.trigger(**trigger) if trigger else w
