"""Stores keyed by fold and seed that separate launches fill, with whole versions only.

    <path>/v=<version>/fold=0/seed=1/part-...   what one write brought, in a folder of its own
    <path>/_manifest/000000007                  which version holds each key: one row per (fold, seed)

A write puts its rows into a new version, then publishes a manifest that has the new keys and all others as they were.
The manifest appears under its number by one rename that fails where the number is taken; a writer that meets another's
manifest takes up its keys and tries the next number.  So a reader sees what one of the writes left, never half of it;
a write that fails leaves the last manifest as it was; and two launches that write different keys at the same time
both stay.  ``vacuum`` deletes the versions that no kept manifest names.

A manifest has as many rows as there are (fold, seed) pairs; rows of the data never come to the driver.  Keys must
not be null.  A key that a write has no row of stays as it was.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("fold", "seed")
DIGITS = 9
#: Files that a task has open at a time, one per key, and the bytes that each gathers: a task with more keys sorts the rest of its rows.
WRITERS, GROUP_BYTES = 32, 32 << 20
_lock, _writing = threading.Lock(), {}


class _Files:
    """Hadoop's file system of a path, as the session is configured for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def publish(self, source: str, target: str) -> bool:
        """Rename a folder; False where the target exists."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(self.path(source)), self.fs.makeQualified(self.path(target)), none)
        except Exception as e:  # py4j wraps what the file system throws
            if "FileAlreadyExists" in str(e) or self.fs.exists(self.path(target)):
                return False
            raise
        return True


def _manifest(spark: SparkSession, files: _Files, path: str) -> tuple[int, list[dict]]:
    """The number of the last manifest (0: none) and its rows."""
    names = [n for n in files.names(f"{path}/_manifest") if n.isdigit()]
    if not names:
        return 0, []
    # one row per (fold, seed)
    return int(names[-1]), [r.asDict() for r in spark.read.parquet(f"{path}/_manifest/{names[-1]}").collect()]


def _write_unsorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by ``keys``.  A task writes a file per key side by side, so its rows are not sorted by key first (and that sort not spilled)."""
    conf, name, session = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters", df.sparkSession._jsparkSession.hashCode()
    with _lock:
        # the first of several writers in a session notes the owner's setting, the last one restores it
        count, old = _writing.get(session, (0, conf.get(name)))
        _writing[session] = count + 1, old
        conf.set(name, max(int(old), WRITERS))
    try:
        df.write.option("parquet.block.size", GROUP_BYTES).partitionBy(*keys).parquet(path)
    finally:
        with _lock:
            count, old = _writing.pop(session)
            if count > 1:
                _writing[session] = count - 1, old
            else:
                conf.set(name, old)


def write_store(df: DataFrame, path: str, keys: Sequence[str] = KEYS) -> str:
    """Write ``df`` so that it replaces the keys that it has and leaves all others; returns ``path``."""
    spark, path, keys = df.sparkSession, path.rstrip("/"), list(keys)
    files, version = _Files(spark, path), uuid.uuid4().hex
    _write_unsorted(df, f"{path}/v={version}", keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    written = spark.read.parquet(f"{path}/v={version}").select(*[F.col(k).cast(types[k]).alias(k) for k in keys])
    # a handful of keys
    own = [r.asDict() for r in written.distinct().collect()]
    if any(v is None for r in own for v in r.values()):
        raise ValueError(f"a key of {keys} is null")
    schema = ", ".join(f"{k} {types[k].simpleString()}" for k in keys) + ", v string"
    while True:
        number, rows = _manifest(spark, files, path)
        taken = {tuple(r[k] for k in keys) for r in own}
        rows = [r for r in rows if tuple(r[k] for k in keys) not in taken] + [{**r, "v": version} for r in own]
        draft = f"{path}/_draft/{uuid.uuid4().hex}"
        spark.createDataFrame([tuple(r[c] for c in (*keys, "v")) for r in rows], schema).coalesce(1).write.parquet(draft)
        files.fs.mkdirs(files.path(f"{path}/_manifest"))
        if files.publish(draft, f"{path}/_manifest/{number + 1:0{DIGITS}d}"):
            return path
        files.fs.delete(files.path(draft), True)


def read_store(spark: SparkSession, path: str, number: int | None = None, **only) -> DataFrame:
    """The rows of the last manifest (or of manifest ``number``); ``only``: a value or a list of values per key."""
    path = path.rstrip("/")
    files = _Files(spark, path)
    if number is None:
        number = _manifest(spark, files, path)[0]
    if not number:
        raise FileNotFoundError(f"no store at {path}")
    manifest = spark.read.parquet(f"{path}/_manifest/{number:0{DIGITS}d}")
    keys, types = [c for c in manifest.columns if c != "v"], dict(manifest.dtypes)
    wanted = {k: set(v) if isinstance(v, (list, tuple, set, range)) else {v} for k, v in only.items() if v is not None}
    rows = manifest.collect()
    hit = [r for r in rows if all(r[k] in v for k, v in wanted.items())]
    # no key asked for is there: the store's columns, no rows
    paths = [f"{path}/v={r['v']}/" + "/".join(f"{k}={r[k]}" for k in keys) for r in hit or rows[:1]]
    df = spark.read.option("basePath", path).parquet(*paths).drop("v")
    df = df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    return df if hit else df.limit(0)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete manifests but the last ``keep``, and the versions that those do not name; returns the versions.  Not to be run while
    a write is under way."""
    path = path.rstrip("/")
    files = _Files(spark, path)
    numbers = [n for n in files.names(f"{path}/_manifest") if n.isdigit()]
    named = {r.v for n in numbers[-keep:] for r in spark.read.parquet(f"{path}/_manifest/{n}").collect()}
    gone = [n[2:] for n in files.names(path) if n.startswith("v=") and n[2:] not in named]
    for n in numbers[:-keep]:
        files.fs.delete(files.path(f"{path}/_manifest/{n}"), True)
    for v in gone:
        files.fs.delete(files.path(f"{path}/v={v}"), True)
    files.fs.delete(files.path(f"{path}/_draft"), True)
    return gone
