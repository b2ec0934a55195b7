"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "linewise", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter sets these."""
    partitions = os.cpu_count() or 8 if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder is lost with its executor.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="linewise-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a column table to the shared folder and read on from there.

    This cuts the lineage, so a lost executor costs one stage, and later readers get
    column pruning and filters on the file. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linewise-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    _goes_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._linewise_path = path
    return table


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when it ends, not when the driver happens to collect its garbage: nobody reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def released(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned. Nothing that is still to run may read them."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._linewise_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _goes_at_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def stored_model(spark: SparkSession, model):  # noqa: ANN001, ANN201
    """A fitted pipeline model written to the shared folder and read back, which leaves its training summary behind.

    The summary of a fit holds the session, and a session that has observed a write cannot be sent to tasks.
    """
    from pyspark.ml import PipelineModel

    path = f"{shared_folder(spark)}/linewise-{uuid.uuid4().hex}"
    model.save(path)
    _goes_at_exit(spark, path)
    return PipelineModel.load(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The name the operators use for ``stored``."""
    return stored(df)
