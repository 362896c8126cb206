"""Claims and commit records on any Hadoop file system.

``claim`` creates an empty file exclusively: of two writers that want one name
exactly one gets it. ``commit`` makes a small JSON record appear whole or not at
all. Data are written first, under a name of their own, and become visible with
the record that names them; what a crashed writer left without a record is
never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is already there."""
    fs, jpath = _file_system(spark, path)
    fs.mkdirs(jpath.getParent())
    try:
        if fs.getScheme() == "file":        # its Hadoop create looks first and writes then
            files, place = _java_path(spark, jpath)
            files.createFile(place, _none(spark, "java.nio.file.attribute.FileAttribute"))
        else:
            fs.create(jpath, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def _java_path(spark: SparkSession, jpath):
    nio = spark.sparkContext._jvm.java.nio.file
    return nio.Files, nio.Paths.get(jpath.toUri().getPath(), _none(spark, "java.lang.String"))


def _none(spark: SparkSession, kind: str):
    """An empty Java array, for optional arguments."""
    sc = spark.sparkContext
    cls = sc._jvm
    for part in kind.split("."):
        cls = getattr(cls, part)
    return sc._gateway.new_array(cls, 0)


def commit(spark: SparkSession, path: str, record: Mapping) -> bool:
    """Write ``record`` as JSON to ``path``; False if there is one already.

    The text goes to a draft that is then renamed without replacing, as Spark's
    own streaming commit log does.
    """
    fs, jpath = _file_system(spark, path)
    if fs.exists(jpath):
        return False
    jvm = spark.sparkContext._jvm
    fs.mkdirs(jpath.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(jpath.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(dict(record), sort_keys=True).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            files, place = _java_path(spark, jpath)
            files.createLink(place, _java_path(spark, draft)[1])
            fs.delete(draft, False)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(draft), fs.makeQualified(jpath), _none(spark, "org.apache.hadoop.fs.Options$Rename"))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        fs.delete(draft, False)
        return False
    return True


def read_record(spark: SparkSession, path: str) -> dict | None:
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath):
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(jpath)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def record_names(spark: SparkSession, folder: str, hidden: bool = False) -> list[str]:
    """Names in a folder, in order (drafts and other hidden files only on request)."""
    fs, jpath = _file_system(spark, folder)
    if not fs.exists(jpath):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(jpath)) if hidden or not n.startswith(("_", ".")))


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _file_system(spark, path)
    fs.delete(jpath, True)
