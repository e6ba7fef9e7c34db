"""What the driver sets up: written tables in the shared folder, and the code for the workers."""

import io
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of spark.checkpoint.dir, or below the warehouse without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    path = f"{folder}/llm/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as a table and read again: its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _packed() -> str:
    """The package as a zip file of the driver, from where Spark sends it to the executors."""
    package = Path(__file__).resolve().parents[1]
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


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` after the workers have been sent this package, once per application."""
    context = df.sparkSession.sparkContext
    _ship(context.applicationId, context)
    return df.mapInArrow(function, schema)
