"""Shared plumbing of the training-data operators: table access and cut lineage."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Scratch paths in the order of their writing.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset: a folder of our own if all
    runs in one local process, else one below the warehouse, which a cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarry-scratch"
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quarry-scratch-")
    return f"file://{_LOCAL[app]}"


def scratch_path(spark: SparkSession) -> str:
    """A new path under the shared folder, remembered so that it can be removed."""
    path = f"{scratch_root(spark)}/quarry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet under the shared folder and read it back.

    Any executor can be lost afterwards; the rows are read again from the shared folder.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file under the shared folder, unless it is there; its path. Its name should come from its data.
    Executors that start later may ask for it, so drop_scratch() leaves it."""
    path = f"{scratch_root(spark)}/quarry-files/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) or fs.getFileStatus(place).getLen() != len(data):
        out = fs.create(place, True)
        out.write(bytearray(data))
        out.close()
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def scratch_mark() -> int:
    """How many scratch tables there are by now; for release_since()."""
    return len(_WRITTEN)


def release_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Remove the scratch tables written since a mark but for the last `keep`. Only for tables that
    nothing will read again: what came of them has been written itself."""
    gone = slice(mark, len(_WRITTEN) - keep)
    for path in _WRITTEN[gone]:
        _delete(spark, path)
    del _WRITTEN[gone]


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table that materialize() wrote for this application."""
    _delete(spark, f"{scratch_root(spark)}/quarry/{spark.sparkContext.applicationId}")
    _WRITTEN.clear()


#: Rows and bytes in a batch that goes to a Python worker, for operators that read whole texts.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python workers have BATCH_ROWS rows and BATCH_BYTES bytes at most, so that two
    workers and their buffers fit beside the heap; smaller settings of the session stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(rows))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, f"{BATCH_BYTES}b")


#: What a Python worker keeps between tasks, each with the time of its last use; seconds after which it is idle.
_KEPT: dict[Hashable, list] = {}
IDLE_SECONDS = 5.0


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), once for a worker and key. Tables of tens of MB stay in a worker from task to task, but what
    another operator has left idle goes first, so that a worker that serves one stage after another holds
    no more than the present one needs."""
    now = time.monotonic()
    if key not in _KEPT:
        for other in [k for k, (_, used) in _KEPT.items() if now - used > IDLE_SECONDS]:
            del _KEPT[other]
        _KEPT[key] = [make(), now]
    _KEPT[key][1] = now
    return _KEPT[key][0]


def result_name(df: DataFrame, stem: str) -> str:
    """stem, or where df has such a column stem with underscores before it."""
    return stem if stem not in {c.lower() for c in df.columns} else fresh_name(df, stem)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def repeats(rows: DataFrame, key: str = "doc_id") -> bool:
    """Whether some key has more than one row."""
    return not rows.groupBy(key).count().filter("count > 1").isEmpty()


#: Keys that may be hot, at most, and rows up to which a key is no load for a task.
MOST_HOT, LEAST_HOT = 10_000, 50_000


def join_hot(big: DataFrame, small: DataFrame, key: list[str], weight: str) -> DataFrame:
    """big.join(small, key) for a small with one row a key and, in `weight`, the rows that big has of it.

    A key that holds over 1 / MOST_HOT of big's rows, and over LEAST_HOT, is hot. There are MOST_HOT of
    them at most, whatever the data, so their rows of small are broadcast and big's stay where they are;
    all other keys meet in a shuffle, and none of these is large.
    """
    total, most = small.agg(F.sum(weight), F.max(weight)).first()
    least = max(LEAST_HOT, (total or 0) / MOST_HOT)
    if (most or 0) <= least:
        return big.join(small, key)
    hot = small.filter(F.col(weight) > least)
    rest = big.join(F.broadcast(hot.select(*key)), key, "left_anti").join(small.filter(F.col(weight) <= least), key)
    return big.join(F.broadcast(hot), key).unionByName(rest)


#: The white space of the contracts, as a Java character class.
SPACE_CLASS = r"\x20\x09-\x0D"


def word_count(text):
    """Number of maximal runs of non-space characters; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")
