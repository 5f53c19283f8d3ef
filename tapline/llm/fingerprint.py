"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if its smallest inner s-mer stands at its first or
last place. That depends on the k-mer alone, so a passage has the same anchors in whatever
text it stands. A fingerprint keeps the ``KEEP`` anchors with the smallest hashes, each with
its place in the text; two fingerprints are compared on the anchors that both would keep,
and a shared anchor counts fully if its displacement agrees with that of the others.

A fingerprint is hexadecimal: the number of code points (8 digits or more, ended by ``:``),
then per anchor 12 digits of hash and 4 of place, in units of 1/65536 of the text's length.

Cases: null texts count as empty; a text without anchors (shorter than k) keeps one anchor
of its whole text, an empty one none; two empty texts are equal (likeness 1), an empty and
another text unlike (0); repeated rows and rows with equal or null ids have rows of their
own, ordered among themselves by their texts; the only row of a table is its own next; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.llm.common import mix, stage

K, S = 16, 6
KEEP = 64
#: Code points of a text that are hashed at a time.
PART = 1 << 18
_U = np.uint64


def _rolled(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(points) - size + 1
    total = np.full(n, seed, np.uint64)
    for k in range(size):
        total = (total + points[k : k + n]) * _U(0x9E3779B97F4A7C15)
        total ^= total >> _U(29)
    return mix(total)


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a text's code points."""
    places, hashes = [], []
    for begin in range(0, max(len(points) - k + 1, 0), PART):
        own = points[begin : begin + PART + k - 1].astype(np.uint64)
        inner = _rolled(own, s, 1)
        n, width = len(own) - k + 1, k - s + 1
        least = inner[:n].copy()
        for j in range(1, width):
            np.minimum(least, inner[j : j + n], out=least)
        closed = np.flatnonzero((inner[:n] == least) | (inner[width - 1 : width - 1 + n] == least))
        places.append(closed + begin)
        hashes.append(_rolled(own, k, 2)[closed])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


Sketch = tuple[int, np.ndarray, np.ndarray]


def sketch(text: str, keep: int = KEEP) -> Sketch:
    """Number of code points, smallest anchor hashes and the places (in 1/65536 of the text) of each first one."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    places, hashes = syncmers(points)
    if not len(places) and text:
        places = np.zeros(1, np.int64)
        hashes = np.array([int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")], np.uint64)
    kept, first = np.unique(hashes >> _U(16), return_index=True)
    return len(points), kept[:keep].astype(np.int64), np.minimum(65535, places[first[:keep]] * 65536 // max(len(points), 1))


def written(mark: Sketch) -> str:
    n, hashes, places = mark
    return f"{n:08x}:" + "".join([f"{h:012x}{p:04x}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def read(mark: str) -> Sketch:
    length, _, rest = mark.partition(":")
    hashes = np.array([int(rest[i : i + 12], 16) for i in range(0, len(rest), 16)], np.int64)
    return int(length, 16), hashes, np.array([int(rest[i + 12 : i + 16], 16) for i in range(0, len(rest), 16)], np.int64)


def likeness(one: Sketch, other: Sketch, keep: int = KEEP) -> float:
    """Share of the anchors of both texts that are common, from the smallest of them.

    A common anchor counts fully if its displacement is near the median of all, else half.
    """
    (na, a, pa_), (nb, b, pb) = one, other
    if na == nb and np.array_equal(a, b) and np.array_equal(pa_, pb):
        return 1.0
    common, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    both = np.union1d(a, b)[:keep]
    inside = common <= both[-1]
    if not inside.any():
        return 0.0
    moved = pb[bt[inside]] * (nb / 65536) - pa_[at[inside]] * (na / 65536)
    agree = np.abs(moved - np.median(moved)) <= 2 + 0.02 * max(na, nb)
    shared = (agree.sum() + 0.5 * (~agree).sum()) / len(both)
    return float(2 * shared / (1 + shared))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """(part, ahead, doc_id, text) in partitions sorted by descending id, nulls last.

    Only ids and text hashes are sorted to find the first row of each part, which is all that
    reaches the driver; the texts move once. Each part also gets that first row of the
    following part (``ahead`` = 1, after its own rows), and the last part that of the first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    parts = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id", "mark").where("doc_id is not null").repartitionByRange(parts, F.desc("doc_id"))
    ids = stage(ids.select("doc_id", "mark", F.spark_partition_id().alias("part")), "fingerprint-ids")
    first = ids.groupBy("part").agg(F.min(F.struct((-F.col("doc_id")).alias("turned"), "mark")).alias("first")).select(F.col("first.turned"), F.col("first.mark")).collect()
    unnamed = rows.where("doc_id is null").agg(F.min("mark").alias("mark")).first()["mark"]
    first.sort()
    known = spark.sparkContext.broadcast((np.array([r["turned"] for r in first], np.int64), np.array([r["mark"] for r in first] + [unnamed or 0], np.int64)))
    total = len(first) + (unnamed is not None)

    @F.pandas_udf("bigint")
    def place(doc_id: pd.Series, mark: pd.Series) -> pd.Series:
        """Twice the part number, plus 1 for its first row."""
        turned, marks = known.value
        null = doc_id.isna().to_numpy()
        own = -doc_id.fillna(0).to_numpy().astype(np.int64)
        part = np.where(null, len(turned), np.searchsorted(turned, own, "right") - 1)
        top = (mark.to_numpy() == marks[part]) & (null | (np.append(turned, 0)[part] == own))
        return pd.Series(part * 2 + top)

    rows = rows.withColumn("place", place("doc_id", "mark"))
    part, top = F.shiftright("place", 1).cast("int"), F.col("place") % 2 == 1
    own, copy = F.struct(part.alias("part"), F.lit(0).alias("ahead")), F.struct(((part + total - 1) % total).alias("part"), F.lit(1).alias("ahead"))
    rows = rows.withColumn("at", F.explode(F.when(top, F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select("at.part", "at.ahead", "doc_id", "mark", "text").repartition("part")
    return rows.sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "mark").select("part", "ahead", "doc_id", "text")


def compared(docs: DataFrame, keep: int = KEEP) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in schema.split(", ")]

    def row(doc_id, text: str, own: Sketch, following: str, after: Sketch) -> tuple:
        new = edited(text, following)
        mark = sketch(new, keep)
        return doc_id, own[0], hashlib.sha256(new.encode()).hexdigest(), written(own), written(mark), likeness(own, mark, keep), likeness(own, after, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ahead and held is None:
                    continue
                now = (part, doc_id, text, sketch(text, keep))
                if held is not None:
                    out.append(row(*held[1:], text, now[3]))
                held = None if ahead else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return in_order(docs).mapInArrow(run, schema)
