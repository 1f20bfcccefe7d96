"""Session, checkpoint and table helpers shared by every job.

Nothing here runs work on the driver: these helpers only configure the
session and hand back lazily-planned DataFrames.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE is the size check behind runtime
# broadcast conversion (a join side is only broadcast after its shuffle
# stage is measured below the threshold) and it splits skewed join
# partitions, which is what keeps a hot key from serialising a join.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "strata",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    On a cluster the directory comes from ``spark.checkpoint.dir`` (a shared
    file system path named by the cluster).  Only a local session with no
    setting gets a private scratch directory, as tests need.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: a cluster job needs a shared checkpoint folder"
        )
    path = tempfile.mkdtemp(prefix="strata-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint directory.

    Used where a later step must see exactly the rows an earlier step saw
    (for example partition ids after a range partitioning), so a lost
    executor re-reads the checkpoint instead of recomputing a different
    assignment.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Spark's setting by which a query's shuffle files go when it ends; else they stay until the driver's memory is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The folders that ``stored`` has written for the table that ``stored_alone`` is building.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("_WRITTEN", default=None)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that ends within are removed with it."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a fresh folder beside the checkpoints and read it back.

    Later passes then read only the columns they use, and joins know its size;
    the shuffle files it took are no longer on disk then."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/strata/{name}-{uuid.uuid4().hex[:12]}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def stored_alone(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored`` of what ``build`` returns; what ``stored`` wrote for it on the way is removed.

    So only for a table on whose way nothing is stored that is read again later."""
    before = _WRITTEN.set([])
    try:
        df, way = build(), _WRITTEN.get()
    finally:
        _WRITTEN.reset(before)
    out = stored(df, name)
    for path in way:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return out


class Built(Mapping[str, DataFrame]):
    """Tables by name, each built when it is asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]) -> None:
        self._builders = builders

    def __getitem__(self, name: str) -> DataFrame:
        return self._builders[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
