"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: dict[str, str] = {}


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "querytide") -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: on a
    cluster such a folder is lost with its machine, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="querytide-")
    return _LOCAL_FOLDER[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, inside this application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/querytide/{app}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Cuts the lineage (a lost executor re-reads files instead of repeating the
    shuffles before it) and pins results of expressions that must not be
    evaluated twice, such as a range partition number.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` returned, once all that reads them is written, and shuffle files of finished writes.

    Spark deletes those when the driver collects its garbage, which may not happen while a long job fills the disks.
    """
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            _delete(df.sparkSession, folder)
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def release_staged(spark: SparkSession) -> None:
    """Delete every table this application staged. Call when results are written."""
    _delete(spark, f"{shared_folder(spark)}/querytide/{spark.sparkContext.applicationId}")
