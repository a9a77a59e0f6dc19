"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage: losing an executor afterwards costs a re-read, not a
recomputation. The folder is ``spark.checkpoint.dir``; only where that is unset and Spark runs in
one process (tests) is a temporary folder made instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_statements: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="nestwork-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed by :func:`cleanup` or when Python ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(cleanup, spark)
    _written[app].append(path)
    return path


def on_cleanup(spark: SparkSession, statement: str) -> None:
    """Run an SQL statement before the files are removed (a table's name ends with its files)."""
    _statements.setdefault(spark.sparkContext.applicationId, []).append(statement)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, with its real size known."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


LOCAL_ROWS = 10_000  # tables of no more rows are kept with the plan


_local: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def kept(df: DataFrame, name: str, small: bool = True) -> DataFrame:
    """``df`` computed once: with the plan itself where it has at most ``LOCAL_ROWS`` rows, else written as by :func:`materialize`.

    What is known not to be ``small`` is written at once; finding out costs the part of ``df`` before its last shuffle.
    """
    if small:
        rows = df.limit(LOCAL_ROWS + 1).toArrow()
        if rows.num_rows <= LOCAL_ROWS:
            found = df.sparkSession.createDataFrame(rows, df.schema)
            _local.add(found)
            return found
    return materialize(df, name)


def is_local(df: DataFrame) -> bool:
    """Whether :func:`kept` found ``df`` small."""
    return df in _local


T = TypeVar("T")


def side_by_side(works: Iterable[Callable[[], T]], most: int = 4) -> list[T]:
    """Results of independent pieces of driver work whose Spark jobs may run at the same time, in order."""
    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(w) for w in works]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are removed at the end; only what was stored elsewhere may be used after it."""
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    if not mine:
        atexit.register(cleanup, spark)
    before = set(mine)
    try:
        yield
    finally:
        for path in [p for p in mine if p not in before]:
            remove(spark, path)
            mine.remove(path)


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under ``path`` on whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results read from them are gone too."""
    try:
        for statement in _statements.pop(spark.sparkContext.applicationId, []):
            spark.sql(statement)
        for path in _written.pop(spark.sparkContext.applicationId, []):
            remove(spark, path)
    except Exception:  # the context has stopped already; its shared folder is cleaned by its owner
        pass


class Files:
    """Small file operations on whatever file system Hadoop knows for a path."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return bool(fs.exists(where))

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it doesn't exist."""
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def sizes(self, path: str) -> dict[str, int]:
        """Data files of a folder and those in it, by path below it, and their lengths."""
        where, fs = self._at(path)
        found: dict[str, int] = {}
        if fs.exists(where):
            base, each = fs.getFileStatus(where).getPath().toUri().getPath(), fs.listFiles(where, True)
            while each.hasNext():
                f = each.next()
                found[f.getPath().toUri().getPath()[len(base) + 1 :]] = int(f.getLen())
        return {k: v for k, v in found.items() if not k.rpartition("/")[2].startswith((".", "_"))}

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a whole file under another name and rename it, so that a reader sees all of it or nothing."""
        where, fs = self._at(path)
        draft = self.jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.delete(where, False)
        if not fs.rename(draft, where):
            raise OSError(f"could not rename to {path}")

    def copy(self, source: str, target: str) -> None:
        a, fs_a = self._at(source)
        b, fs_b = self._at(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, True, self.conf)

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)
