"""Session helpers: a tuned local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # (spark.sql.codegen.maxFields left at its default: wide window projections above
    #  it run faster outside whole-stage codegen than as huge generated methods)
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "flowrisk", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("FLOWRISK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as named in ``spark.checkpoint.dir``.

    On a cluster the setting has to name a shared, fault-tolerant file system; a session
    without it is refused there, because a folder of the driver's machine would be
    invisible to the executors.  Only a single-process ``local[...]`` session (tests, the
    bench) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="flowrisk-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


#: Rows that one task is given at most, about, where it sorts, groups or windows all of its rows.
ROWS_PER_TASK = 1 << 19


def tasks_needed(spark: SparkSession, rows: int) -> int | None:
    """Tasks that ``rows`` need; None for rows that the cores can take at once."""
    n = -(-rows // ROWS_PER_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def spread(df, rows: int, *cols):
    """``df`` hash-partitioned by ``cols`` into as many tasks as its ``rows`` need.

    Rows that the cores can take at once keep the session's number of partitions.  More rows get
    a number of their own: neither that setting nor coalescing by compressed bytes (a regular
    grid compresses to a few bytes a row) may make a task grow with the table.
    """
    n = tasks_needed(df.sparkSession, rows)
    return df.repartition(*cols) if n is None else df.repartition(n, *cols)


#: The lists that collect what ``stage`` writes, innermost last (see ``staged_tables``).
_COLLECTORS: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())


@contextmanager
def staged_tables():
    """The paths that ``stage`` writes within the block, for their owner to drop.

    They belong to whoever opened the block; tables staged outside of any block stay.
    """
    own: list[str] = []
    outer = _COLLECTORS.set((*_COLLECTORS.get(), own))
    try:
        yield own
    finally:
        _COLLECTORS.reset(outer)


def stage(df, name: str = "stage"):
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts long lineages (and the plan size) where a result is reused several times;
    the written table survives executor loss, unlike cached blocks.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    for own in _COLLECTORS.get():
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables through the file system that holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
