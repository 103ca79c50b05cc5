"""Order-free digests of a table's content, and what differs where they do."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key ranges that are compared by digest before any row is.
BUCKETS = 4096


class Digest(NamedTuple):
    """Rows, and sum and exclusive or of their hashes; the sum sees a row that is there twice."""

    rows: int
    total: int
    mixed: int

    @classmethod
    def of(cls, row) -> Digest:
        return cls(int(row["rows"]), int(row["total"] or 0), int(row["mixed"] or 0))


def row_hash(columns: Sequence[str]) -> Column:
    """Of all values with their place: a NULL is not skipped."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def measures(columns: Sequence[str]) -> list[Column]:
    """The digest as aggregates, to be observed in a write or grouped."""
    hashed = row_hash(columns)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(hashed.cast("decimal(20,0)")).alias("total"),
        F.bit_xor(hashed).alias("mixed"),
    ]


def digest(frame: DataFrame) -> Digest:
    return Digest.of(frame.agg(*measures(frame.columns)).first())


def row_differences(delivered: DataFrame, loaded: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Keys whose rows differ: ``lost``, ``added``, ``repeated`` (the same rows, other
    counts) or ``altered``, with the rows on either side.

    Two levels. One digest per bucket of keys is compared first, a table of at most
    `buckets` rows; only rows of buckets that differ are shuffled by key.
    """
    columns = delivered.columns
    if sorted(columns) != sorted(loaded.columns):
        raise ValueError(f"columns differ: {columns} and {loaded.columns}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    sides = [side.select(bucket, *columns) for side in (delivered, loaded)]
    sums = [side.groupBy("_bucket").agg(F.struct(*measures(columns)).alias(name)) for side, name in zip(sides, "ab")]
    differing = sums[0].join(sums[1], "_bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("_bucket")
    # At most `buckets` rows are broadcast.
    rows = [side.join(F.broadcast(differing), "_bucket", "left_semi") for side in sides]
    per_row = [
        side.groupBy(*keys, row_hash(columns).alias("_row")).agg(
            (F.count(F.lit(1)) if name == "a" else F.lit(0).cast("bigint")).alias("_a"),
            (F.count(F.lit(1)) if name == "b" else F.lit(0).cast("bigint")).alias("_b"),
        )
        for side, name in zip(rows, "ab")
    ]
    both = (
        per_row[0]
        .unionByName(per_row[1])
        .groupBy(*keys, "_row")
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        .groupBy(*keys)
        .agg(
            F.sum("_a").alias("delivered_rows"),
            F.sum("_b").alias("loaded_rows"),
            F.count_if(F.col("_a") != F.col("_b")).alias("_differ"),
            F.count_if((F.col("_a") == 0) | (F.col("_b") == 0)).alias("_one_sided"),
        )
    )
    status = (
        F.when(F.col("loaded_rows") == 0, "lost")
        .when(F.col("delivered_rows") == 0, "added")
        .when(F.col("_one_sided") == 0, "repeated")
        .otherwise("altered")
    )
    return both.filter("_differ > 0").select(*keys, status.alias("status"), "delivered_rows", "loaded_rows")
