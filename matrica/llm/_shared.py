"""Things the corpus operators share: the shared folder, tables cut from their
lineage, and the tables of a directory."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (a local master, as in tests) may be without
    it: a temporary folder is made then, remembered in the session's settings
    and removed at the end of the process.  Elsewhere its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("matrica.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="matrica-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = "file://" + made
        spark.conf.set("matrica.shared.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written while a ``scratch`` is open.
_made: list[DataFrame] = []


@contextlib.contextmanager
def scratch():
    """Yields a list; tables written inside that are not put in it are removed at the end."""
    start, keep = len(_made), []
    yield keep
    kept = {id(k) for k in keep}
    discard(*(t for t in _made[start:] if id(t) not in kept))
    _made[start:] = keep


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there,
    the files survive the loss of any executor, and nothing is computed twice."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._matrica = (path, None)
    _made.append(out)
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``materialize``, bucketed by ``key``: joins on it, with sides dealt to ``_buckets`` parts, leave the rows where they are.

    As many buckets as the input has partitions, within Spark's own bound of 100,000.
    """
    spark = df.sparkSession
    path, name = fresh_path(spark, name), f"matrica_{uuid.uuid4().hex}"
    n = min(100_000, max(2 * spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._matrica, out._buckets = (path, name), n
    _made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` or ``bucketed`` wrote, once nothing reads it any more."""
    for df in tables:
        spark, (path, name) = df.sparkSession, df._matrica
        _made[:] = [t for t in _made if t is not df]
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int, rows: int = 8):
    """For what is run inside: Arrow batches of at most so many bytes, and Parquet
    batches of so many rows, as rows may be of a megabyte each; rows that are
    large by themselves go one by one."""
    key, read = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {k: spark.conf.get(k) for k in (key, read)}
    now = before[key].rstrip("b")
    spark.conf.set(key, str(min(most, int(now) if now.isdigit() else most)))
    spark.conf.set(read, str(rows))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Let shuffles that nothing refers to any more go now, not at the cleaner's next turn.

    Handles that Python has dropped are passed on to the JVM within a second.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1)
        spark._jvm.System.gc()


#: What operators keep in this Python worker, by operator.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` keeps for its next tasks in this Python worker.

    Workers outlive stages and are used by all of them, so what other
    operators kept is dropped: a worker holds the tables of one at a time.
    """
    if any(v for k, v in _kept.items() if k != owner):
        for k in [k for k in _kept if k != owner]:
            del _kept[k]
        gc.collect()
    return _kept.setdefault(owner, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(df: DataFrame, *cols: str, per_core: int = 2) -> DataFrame:
    """Deal rows evenly when the input has fewer partitions than twice the cores.

    Costs a shuffle, so it is for small inputs whose processing is heavy.
    """
    n = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(n, *cols) if cols else df.repartition(n)
