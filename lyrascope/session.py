"""Session helpers: building, lineage cuts and guarded broadcasts."""

import io
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row counts up to which a lookup table may be broadcast.  A lookup row is a key plus a
# few numbers (about 100 bytes), so the limit keeps a broadcast near 50 MB.
BROADCAST_ROWS = 500_000


def build_session(app: str, cpus: str | int = "*", memory: str = "8g", **conf) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    partitions = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or one below the warehouse without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return shared


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which is deleted when the session ends."""
    path = f"{shared_folder(spark)}/lyrascope/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    place.getFileSystem(configuration).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this session wrote below the shared folder and needs no more."""
    if not path.startswith(f"{shared_folder(spark)}/lyrascope/"):
        raise ValueError(f"{path} is not below the shared folder")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write a (narrow) intermediate table to the shared folder and continue from there.

    Used where several branches read the same expensive result: the texts are then
    scanned once, a lost executor costs no recomputation, and later reads are columnar
    and have a known size.  The table is deleted when the session ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a table whose counted rows stay under the limit."""
    return F.broadcast(df) if rows <= limit else df


@cache
def _packed() -> str:
    """The package as a zip file on the driver."""
    package = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    path.write_bytes(held.getvalue())
    return str(path)


@cache
def _ship(application: str, context) -> None:
    context.addPyFile(_packed())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    _ship(context.applicationId, context)
