"""Order-dependent building blocks that never put a whole key into one task.

A key (a call, a flow, a stream) may hold a large share of all rows, and
adaptive execution does not split window partitions. Each helper therefore
works in two levels: a window inside (key, chunk), then a window over one
summary row per chunk, joined back. ``chunk`` has to grow with the order.

Rows are repartitioned on (key, chunk) explicitly: Spark would accept an input
that is already partitioned on the key alone, and keep the key in one task. Summary
rows grow with the keys, so they are joined by sort-merge and not broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Rows of one key that one task may hold in order; a tuning value, not a limit.
CHUNK_ROWS = 1 << 18


def chunk_of(order: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense, growing row number."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(rows)).cast("bigint")


def time_chunk(t: str | Column, seconds: float) -> Column:
    """Chunk number of a time, null counting as zero."""
    col = F.col(t) if isinstance(t, str) else t
    return F.floor(F.coalesce(col, F.lit(0.0)) / F.lit(float(seconds))).cast("bigint")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: str,
    values: dict[str, str | Column],
) -> DataFrame:
    """Add, per row, values of the row before it within its key (null at the first).

    ``keys``, ``chunk`` and ``order`` must not be null; ``order`` is unique in a key.
    """
    part = [*keys, chunk]
    packed = F.struct(
        *[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()]
    )
    base = df.withColumn("_cur", packed)
    inner = base.repartition(*part).withColumn(
        "_prev", F.lag("_cur").over(W.partitionBy(*part).orderBy(order))
    )
    tails = base.groupBy(*part).agg(F.max_by("_cur", order).alias("_tail"))
    carry = tails.select(
        *part, F.lag("_tail").over(W.partitionBy(*keys).orderBy(chunk)).alias("_carry")
    )
    joined = inner.join(carry.hint("merge"), part, "left")
    prev = F.coalesce("_prev", "_carry")
    return joined.select(*df.columns, *[prev[n].alias(n) for n in values])


def dense_index(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], name: str
) -> DataFrame:
    """Number the rows of every key 0, 1, 2, … in the given order."""
    part = [*keys, chunk]
    inner = df.repartition(*part).withColumn(
        "_rn", F.row_number().over(W.partitionBy(*part).orderBy(*order))
    )
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = sizes.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return inner.join(offsets.hint("merge"), part, "left").select(
        *df.columns, (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(name)
    )


def range_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, keep: Callable[[str, DataFrame], DataFrame], partitions: int | None = None
) -> DataFrame:
    """Number the rows of every key 0, 1, 2, … in the given order, whatever the values are like.

    One range partition by sampled splitters over (keys, order) sorts all rows, so a key is cut
    where it is large and not by any value of it. A row's number is its place in its part, less
    that of the key's first row there, and the key's rows in the parts before. ``keep`` stores a
    table: the parts are numbered once.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = keep(f"{name}_ranges", ranged.withColumn("_id", F.monotonically_increasing_id()))
    placed = ranged.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return placed.join(offsets.hint("merge"), [*keys, "_part"]).select(*df.columns, (F.col("_id") + F.col("_off")).cast("bigint").alias(name))


def running_total(
    df: DataFrame, keys: Sequence[str], chunk: str, order: str, value: str | Column, name: str
) -> DataFrame:
    """Inclusive running sum of a non-null number per key."""
    part = [*keys, chunk]
    base = df.withColumn("_v", F.col(value) if isinstance(value, str) else value)
    upto = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = base.groupBy(*part).agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*part, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    return (
        base.repartition(*part)
        .withColumn("_in", F.sum("_v").over(upto))
        .join(offsets.hint("merge"), part, "left")
        .select(*df.columns, (F.col("_off") + F.col("_in")).alias(name))
    )


def as_of_last(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    right_order: Sequence[str],
    values: dict[str, str],
    tolerance: float = 0.0,
    bucket_seconds: float = 300.0,
) -> DataFrame:
    """Left rows with values of the last right row at or before time + tolerance.

    Both sides meet inside (keys, time bucket); what earlier buckets hold
    arrives as one carried row per bucket.
    """
    picked = F.struct(
        *[F.col(right_time).alias("_t")],
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)],
        *[F.col(v).alias(n) for n, v in values.items()],
    )
    lt = left.withColumn("_at", F.col(left_time) + F.lit(float(tolerance)))
    lt = lt.withColumn("_bucket", time_chunk("_at", bucket_seconds))
    rt = right.where(F.col(right_time).isNotNull()).select(
        *keys, time_chunk(right_time, bucket_seconds).alias("_bucket"), picked.alias("_r")
    )
    part = [*keys, "_bucket"]
    tails = rt.groupBy(*part).agg(F.max("_r").alias("_tail"))
    buckets = lt.select(*part).distinct().withColumn("_tail", F.lit(None).cast(tails.schema["_tail"].dataType))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        tails.unionByName(buckets)
        .groupBy(*part)
        .agg(F.max("_tail").alias("_tail"))
        .select(*part, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    )
    left_rows = lt.select(
        *part, F.col("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(tails.schema["_tail"].dataType).alias("_r"),
    )
    right_rows = rt.select(
        *part, F.col("_r._t").alias("_at"), F.lit(0).alias("_side"),
        F.lit(None).cast(left_rows.schema["_l"].dataType).alias("_l"), F.col("_r"),
    )
    run = (
        W.partitionBy(*part).orderBy("_at", "_side", "_r").rowsBetween(W.unboundedPreceding, 0)
    )
    merged = (
        left_rows.unionByName(right_rows)
        .repartition(*part)
        .withColumn("_hit", F.last("_r", ignorenulls=True).over(run))
        .where("_side = 1")
        .join(carry.hint("merge"), part, "left")
    )
    hit = F.coalesce("_hit", "_carry")
    return merged.select("_l.*", *[hit[n].alias(n) for n in values])
