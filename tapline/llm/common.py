"""Shared helpers of the text operators: stages, Arrow batches, byte hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.session import work_path

#: Bytes of text a task expands to eight-byte words at a time; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
_U = np.uint64


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    target = work_path(spark, name)
    df.write.parquet(target)
    found = spark.read.schema(df.schema).parquet(target)
    found.stage_path = target
    return found


def discard(staged: DataFrame) -> None:
    """Delete a table of ``stage``. All that was made from it has to be written by then, so that
    a lost executor never asks for it again."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.stage_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def arrow_map(df: DataFrame, schema: str, batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if one.num_rows:
                yield from batch(one)

    return df.mapInArrow(run, schema)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, joined, and the row offsets; null counts as empty."""
    binary = pa.concat_arrays([column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())])
    _, offsets, data = binary.buffers()
    bounds = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def blocks(bounds: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``limit`` bytes, one row at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    inverse = _powers(_BASE_INVERSE, n + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words in joined rows; words end at row bounds.

    ``separator`` says of each byte value whether it separates words.
    """
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(bounds, starts, "right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size`` words in a row of text and their row numbers, repeated ones too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total + words[k : k + n] * _U(2 * k + 0x9E3779B97F4A7C15))
    whole = rows[:n] == rows[size - 1 :]
    return total[whole], rows[:n][whole]


#: Bits of ``only_listed``'s filter: 8 MB, whatever the size of the input.
FILTER_BITS = 1 << 26


def only_listed(rows: DataFrame, column: str, listed: DataFrame, inverse: bool = False) -> DataFrame:
    """Rows whose ``column`` may stand in ``listed`` (or, with ``inverse``, the others).

    A bitmap of fixed size, broadcast as at most 2,048 rows of 4 KB, drops most of the other
    rows before a shuffle; a false pass costs time only.
    """
    spot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
    bits = listed.select(F.bitmap_bucket_number(spot).alias("_k"), F.bitmap_bit_position(spot).alias("_p")).groupBy("_k").agg(F.bitmap_construct_agg("_p").alias("_bits"))
    marked = rows.withColumns({"_k": F.bitmap_bucket_number(spot), "_p": F.bitmap_bit_position(spot)}).join(F.broadcast(bits), "_k", "left")
    has = F.coalesce(F.expr("cast(conv(hex(substring(_bits, cast(_p div 8 as int) + 1, 1)), 16, 10) as int) >> cast(_p % 8 as int) & 1 = 1"), F.lit(False))
    return marked.where(~has if inverse else has).select(*rows.columns)


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Every round takes the smallest label of the neighbours and then follows the label's own
    label, so long chains halve. Each round is written to the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), name)
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), name)
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("low"))
        low = stage(low, name)
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("far"))
        after = low.join(jump, "low", "left").select("node", F.col("component").alias("was"), F.least("low", "far").alias("component"))
        after = stage(after, name)
        labels = after.select("node", "component")
        if not after.where("was <> component").limit(1).count():
            return labels


#: Keys of ``joined_by_key`` that are broadcast, at most.
HOT_KEYS = 10_000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str | list[str], sizes: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key) that doesn't gather hot keys.

    ``sizes`` holds the number of rows (n) of each key. Keys with more than a 1 / HOT_KEYS
    share of the rows, of which there can be no more than HOT_KEYS, meet their rows by
    broadcast, so the rows stay where they are; the others are shuffled.
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    keys = [key] if isinstance(key, str) else key
    hot = sizes.where(F.col("n") > max(total / HOT_KEYS, 1000)).select(*keys)
    few = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))
