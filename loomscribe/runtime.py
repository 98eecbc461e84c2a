"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_WORK: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def session(app: str = "loomscribe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect; explicit conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map={k: str(v) for k, v in settings.items()}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has far fewer tasks than there are cores (one small file); else df itself.

    For text functions that cost far more than a shuffle of their input. A large table has more scan tasks than cores
    and is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def workdir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only on a local master, where that is unset.

    On a cluster a machine's own folder would hold only the parts its executors wrote, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(?:\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_WORK:
        _LOCAL_WORK[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_WORK[app]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts lineage so that a lost executor costs no recomputation of the steps before, and gives
    the reader real sizes, so that Spark broadcasts the table only when it is under its threshold.
    The table stays until `release`.
    """
    spark = df.sparkSession
    path = f"{workdir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that `cut` wrote so far in this application, and returns how many.

    To be called when results are written or collected: a query that still reads one of the tables fails after it.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)
