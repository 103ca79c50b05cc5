"""Reading and writing tables, run-date landing, load reconciliation."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import digest
from ..operators.digest import Digest


class LoadMismatch(RuntimeError):
    """Loaded tables do not hold exactly the rows that were delivered."""


def shared_dir(spark: SparkSession) -> str:
    """A new directory below the folder the cluster names in
    ``spark.checkpoint.dir``, or below the warehouse where that is unset; every
    executor can read both."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return f"{base.rstrip('/')}/tradewind-{uuid.uuid4().hex}"


def materialize(frame: DataFrame) -> DataFrame:
    """Writes `frame` once as Parquet in the shared folder and reads it back.

    Used where several results start from the same expensive rows. Unlike an
    in-memory copy the table survives lost executors, and readers still prune
    columns and push filters.
    """
    path = shared_dir(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; a malformed row is an error."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


# Values are written as they are; the writer would trim them.
CSV_WRITE = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def declared_columns(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in the declared order."""
    return frame.select(*schema.names)


def with_extra_tables(tables: Mapping[str, DataFrame], extra: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds an extension's tables; taking an existing name is an error."""
    clash = sorted(set(tables) & set(extra))
    if clash:
        raise ValueError(f"tables already exist: {clash}")
    return {**tables, **extra}


def create_table_ddl(database: str, name: str, schema: T.StructType) -> str:
    columns = ",\n    ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {database}.{name} (\n    {columns}\n) USING parquet"


def replace_table(frame: DataFrame, path: str) -> None:
    """Full replacement of one table; returns when the write is complete."""
    frame.write.mode("overwrite").parquet(path)


def write_observed(frame: DataFrame, write: Callable[[DataFrame], None]) -> Digest:
    """The digest of exactly the rows that `write` wrote, from that same pass."""
    seen = Observation()
    write(frame.observe(seen, *digest.measures(frame.columns)))
    return Digest.of(seen.get)


def replace_checked(frames: Mapping[str, DataFrame], expected: Mapping[str, Digest], root: str) -> dict[str, DataFrame]:
    """Full replacement of several tables below `root`, all of them or none.

    Each frame is read once and written to a new folder, its content observed on
    the way; where a digest isn't the expected one (or there is none), the error says so and
    the tables stay as they were. Otherwise a one-row file per table is
    replaced last, which names the folder that readers take. Folders of earlier
    loads are left to the store's retention policy.
    """
    spark = next(iter(frames.values())).sparkSession
    version = uuid.uuid4().hex
    wrong = []
    for name, frame in frames.items():
        found = write_observed(frame, lambda f, n=name: f.write.parquet(f"{root}/{n}/{version}"))
        if name not in expected:
            wrong.append(f"{name}: nothing says what was delivered")
        elif found != expected[name]:
            what = f"expected {expected[name].rows}, found {found.rows}" if found.rows != expected[name].rows else "other values"
            wrong.append(f"{name}: {what}")
    if wrong:
        raise LoadMismatch(f"loaded tables differ from the delivered ones: {'; '.join(wrong)}")
    for name in frames:
        current = spark.createDataFrame([(version,)], "version STRING")
        current.coalesce(1).write.mode("overwrite").json(f"{root}/{name}/_current")
    return {name: read_current(spark, root, name, frame.schema) for name, frame in frames.items()}


def read_current(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """The rows of the last load of a table that was checked."""
    version = read_existing(spark.read.schema("version STRING"), f"{root}/{name}/_current", f"loaded table '{name}'").first()
    return spark.read.schema(schema).parquet(f"{root}/{name}/{version['version']}")


def land_run(frame: DataFrame, root: str, table: str, run_date: dt.date) -> Digest:
    """Files one run under ``<root>/<table>/run_date=<day>`` and returns its digest.
    Landing the same day again replaces that day only; earlier runs are kept."""

    def write(rows: DataFrame) -> None:
        (
            rows.withColumn("run_date", F.lit(run_date))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .options(**CSV_WRITE)
            .partitionBy("run_date")
            .csv(f"{root.rstrip('/')}/{table}")
        )

    return write_observed(frame, write)


def read_run(spark: SparkSession, root: str, table: str, schema: T.StructType, run_date: dt.date) -> DataFrame:
    return read_table(spark, f"{root.rstrip('/')}/{table}/run_date={run_date.isoformat()}", schema)


def write_manifest(spark: SparkSession, root: str, run_date: dt.date, facts: Mapping[str, object]) -> None:
    """What a run was made from, next to its tables; written after the load so
    that a manifest stands for a complete run."""
    rows = [(key, str(value)) for key, value in facts.items()]
    manifest = spark.createDataFrame(rows, "key STRING, value STRING").withColumn("run_date", F.lit(run_date))
    (
        manifest.coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .json(f"{root.rstrip('/')}/_manifest")
    )


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return read_existing(
        spark.read.schema("key STRING, value STRING, run_date DATE"), f"{root.rstrip('/')}/_manifest", "manifest"
    )


def read_existing(reader, path: str, what: str) -> DataFrame:
    """JSON at `path`; a missing path names what should have been written."""
    try:
        return reader.json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no {what} at {path}: run the refresh first") from error
        raise


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counted = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def reconcile(expected: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """Delivered and loaded row counts per table, with ``matches``."""
    return (
        row_counts(expected)
        .withColumnRenamed("rows", "expected")
        .join(row_counts(loaded).withColumnRenamed("rows", "actual"), "table", "full")
        .withColumn("matches", F.col("expected").eqNullSafe(F.col("actual")))
    )


def verify_load(expected: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> None:
    wrong = reconcile(expected, loaded).filter(~F.col("matches")).collect()  # one row per table
    if wrong:
        shown = "; ".join(f"{r['table']}: expected {r['expected']}, found {r['actual']}" for r in wrong)
        raise LoadMismatch(f"loaded tables differ from the delivered ones: {shown}")
