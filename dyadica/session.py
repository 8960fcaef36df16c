"""Session helpers shared by every operator: table scans, shared checkpoints, task spread."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "dyadica", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The archive is served by the driver; workers that have the package installed prefer theirs.
    """
    sc = spark.sparkContext
    if getattr(sc, "_dyadica_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="dyadica-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    here = Path(__file__).resolve().parent
    sc.addPyFile(shutil.make_archive(f"{folder}/dyadica", "zip", here.parent, here.name))
    sc._dyadica_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table of a data directory; pruning and pushdown stay with Catalyst."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent (a local test session) a folder of our own is set.
    """
    ship(spark)
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = sc.getCheckpointDir()
        if named is None:
            named = tempfile.mkdtemp(prefix="dyadica-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark deletes a query's shuffle files as it ends, not when its driver collects garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Like :func:`cut_lineage`, but columnar and several times smaller, for large tables. A
    table stays until :func:`discard` or :func:`release`, as results may still be read from it.
    With ``sweep``, the shuffle files that made it are deleted as soon as it stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dyadica-{uuid.uuid4().hex}"
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true" if sweep else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SWEEP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._dyadica_path = path
    sc = spark.sparkContext
    sc._dyadica_written = [*getattr(sc, "_dyadica_written", []), path]
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for path in paths:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    sc._dyadica_written = [p for p in getattr(sc, "_dyadica_written", []) if p not in set(paths)]


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no result reads any more.

    An operator calls it once its later tables are written, so that only what the result is
    read from stays in the shared folder.
    """
    if tables:
        _delete(tables[0].sparkSession, [t._dyadica_path for t in tables])


def release(spark: SparkSession) -> int:
    """Delete all tables that :func:`written` left in the shared folder; how many there were."""
    paths = list(getattr(spark.sparkContext, "_dyadica_written", []))
    _delete(spark, paths)
    return len(paths)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin rows that come in fewer partitions than the cluster has cores.

    Used before CPU-heavy Python stages only; a scan of many splits is returned as it is.
    Nothing is run to find out: a plan with exchanges, whose partitions adaptive execution
    only settles while it runs, is always spread.
    """
    ship(df.sparkSession)
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df.repartition(want)
    return df.repartition(want) if execution.toRdd().getNumPartitions() < want // per_core else df


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(col: Column) -> Column:
    """Trim all Unicode white space and lower the case: the clean form of an identifier."""
    return F.lower(F.regexp_replace(col.cast("string"), r"(?U)^\s+|\s+$", ""))
