"""Tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write once, read back: later readers don't repeat the work, and lost executors don't lose it."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    schema = frame.schema
    frame.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, once: functions
    that run on executors import it there."""
    context = spark.sparkContext
    if getattr(context, "_tradewind_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # on the driver; Spark sends it
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._tradewind_shipped = True
