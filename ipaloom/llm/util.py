"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: White space between words: space and the control characters 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"
#: Characters of a word that the classifiers hash as one.
LONG = 64
_PIECES = re.compile(rf"[^\W_]{{1,{LONG}}}|[\W_]{{1,{LONG}}}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also when it is not installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a folder of our own if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ipaloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and gives
    the optimizer the true size of the data.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ipaloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``frames``; their rows can't be read afterwards."""
    for df in frames:
        for name in df.inputFiles()[:1]:
            for path in [p for p in _written if p.rpartition("/")[2] in name]:
                _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for path, spark in _written.items():
        if spark.sparkContext._jsc is None or not spark.sparkContext._jsc.sc().isStopped():
            try:
                _delete(path, spark)
            except Exception:  # the JVM may be gone at exit
                return


def tidy(*caches: dict) -> None:
    """Give a worker's memory back at the end of a task: empty its caches and the allocators' free lists."""
    import ctypes

    import pyarrow

    for c in caches:
        c.clear()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (expressions in a lambda are not shared by Catalyst)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(docs: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold_of(n: int) -> Column:
    """crc32 of the decimal text of doc_id, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def pieces(text: str) -> list[str]:
    """Words between white space; those over LONG characters are cut into runs of letters and digits and runs of others, of LONG characters at most."""
    words = text.split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [p for w in words for p in ((w,) if len(w) <= LONG else _PIECES.findall(w))]


def text_map(docs: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn(iterator of (doc_ids, texts, rows))`` over (doc_id, text) Arrow batches."""
    ship(docs.sparkSession)
    return docs.mapInArrow(fn, schema)
