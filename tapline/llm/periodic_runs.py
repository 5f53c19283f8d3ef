"""Periodic runs of words: stretches that repeat a block of words over and over.

A run is a stretch of words with smallest period q and at least max(LEAST_WORDS, REPEATS * q)
words that no neighbouring word extends keeping the period.

1. A document is cut into overlapping tiles for every octave of periods [2^k, 2^(k+1)). Tiles
   of one octave overlap by ``REPEATS`` of its longest periods, so each piece of a run that is
   long enough to show lies whole in some tile. Octaves whose overlap fits the base tile share
   tiles; a document of one tile is solved where it is read, the tiles of longer ones are dealt
   over the tasks.
2. In a tile boundaries stand every 2^k words. For a boundary b the block of 2^k words behind
   it is compared with the blocks q words further on, one comparison a word and octave; where
   they agree, the boundary's Z values, how far w[b..] and w[b+q..] agree onwards and
   backwards, give the whole fragment with period q round b. Z values are read off hashes of
   blocks of every power of two, so all boundaries of a batch of tiles are solved at once.
3. Fragments are shuffled by document and period. Fragments that overlap by a period or more
   are one fragment; of equal fragments the smallest period counts, since a longer one that
   covers the same words is a multiple of it.

Words are compared through 64-bit hashes of blocks.

Cases: null, empty and blank texts have no words, no runs and an empty kept text; the order of
equal rows doesn't matter, repeated rows (also with a null id) each get their own equal result;
an empty table gives no rows; other columns are ignored, whatever their names. A text of any
length is cut into tiles, so a task holds the words of one text and one tile at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapline.llm.common import arrow_map, blocks, mix, only_listed, span_hashes, stage, text_column, word_spans

#: A run covers its period at least so often, and at least so many words.
REPEATS = 4
LEAST_WORDS = 6
#: Words of a base tile.
TILE_WORDS = 1 << 13
#: Texts above so many bytes are tiled over the tasks. Whether they are changes no result.
SPREAD_BYTES = 1 << 16
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
FRAGMENT = "doc_id bigint, mark bigint, period bigint, first bigint, past bigint"


def octave_tiles(n: int, base: int = TILE_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(first word, words, first octave, last octave) of the tiles of a document of ``n`` words."""
    last = (n // REPEATS).bit_length() - 1
    if last < 0:
        return
    if n <= base:
        yield 0, n, 0, last
        return
    # An octave's overlap holds REPEATS of its longest periods and the shortest run there is.
    shared = 0
    while 2 * (REPEATS << (shared + 2)) <= base:
        shared += 1
    low = 0
    while low <= last:
        high = min(last, shared) if not low else low
        overlap = max(REPEATS << (high + 1), LEAST_WORDS)
        size = max(base if not low else 0, 2 * overlap)
        if size >= n:
            yield 0, n, low, last
            return
        at = 0
        while True:
            yield at, min(size, n - at), low, high
            if at + size >= n:
                break
            at += size - overlap
        low = high + 1


class Blocks:
    """Hashes of the blocks of 2^j words at every place of joined tiles, shortest tiles first."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.size = np.diff(bounds)
        self.begin = np.repeat(bounds[:-1], self.size)
        self.end = np.repeat(bounds[1:], self.size)
        self.bounds = bounds
        self.levels, self.start = [words], [0]
        level = 1
        while len(self.size) and self.size[-1] >= 1 << level:
            # Only tiles long enough have such blocks, and they come last.
            start = int(bounds[np.searchsorted(self.size, 1 << level)])
            below, half = self.levels[-1][start - self.start[-1] :], 1 << (level - 1)
            ahead = np.zeros(len(below), np.uint64)
            ahead[: len(below) - half] = below[half:]
            self.levels.append(mix(below * _STEP + ahead))
            self.start.append(start)
            level += 1

    def same(self, j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        level, start = self.levels[j], self.start[j]
        return level[x - start] == level[y - start]

    def onwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For how many words the text from x equals that from y (x < y, same tile)."""
        far, end = np.zeros(len(x), np.int64), self.end[x]
        for j in range(len(self.levels) - 1, -1, -1):
            for _ in range(2 if j == len(self.levels) - 1 else 1):
                fits = np.flatnonzero(y + far + (1 << j) <= end)
                fits = fits[self.same(j, x[fits] + far[fits], y[fits] + far[fits])]
                far[fits] += 1 << j
        return far

    def backwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For how many words the text before x equals that before y (x < y, same tile)."""
        far, begin = np.zeros(len(x), np.int64), self.begin[x]
        for j in range(len(self.levels) - 1, -1, -1):
            for _ in range(2 if j == len(self.levels) - 1 else 1):
                fits = np.flatnonzero(x - far - (1 << j) >= begin)
                fits = fits[self.same(j, x[fits] - far[fits] - (1 << j), y[fits] - far[fits] - (1 << j))]
                far[fits] += 1 << j
        return far


def tile_fragments(words: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile, period, first word, word behind) of the fragments of joined tiles, by their octaves low..high.

    Octaves below ``low`` are solved too, but only to leave out multiples of their periods.
    """
    order = np.argsort(np.diff(bounds), kind="stable")
    size = np.diff(bounds)[order]
    own = np.concatenate([[0], np.cumsum(size)])
    words = words[np.repeat(bounds[:-1][order] - own[:-1], size) + np.arange(own[-1])]
    low, high = low[order], high[order]
    hashed = Blocks(words, own)
    tile_of = np.repeat(np.arange(len(size)), size)
    # Up to which word a run that starts here or before reaches.
    reach = np.zeros(len(words), np.int64)
    found = []
    for k in range(int(high.max(initial=-1)) + 1):
        span = 1 << k
        if k >= len(hashed.levels):
            break
        start = int(own[np.searchsorted(size, REPEATS * span)])
        y = np.arange(start, len(words))
        inside = y - hashed.begin[start:]
        y = y[(inside >= span) & (y + span <= hashed.end[start:]) & (k <= high[tile_of[start:]])]
        b = hashed.begin[y] + (((y - hashed.begin[y]) >> k) - 1 << k)
        hit = hashed.same(k, b, y)
        b, y = b[hit], y[hit]
        fresh = reach[b] < y + span
        b, y = b[fresh], y[fresh]
        if not len(b):
            continue
        first, past = b - hashed.backwards(b, y), y + hashed.onwards(b, y)
        period = y - b
        whole = past - first >= np.maximum(REPEATS * period, LEAST_WORDS)
        rows = np.unique(np.stack([first[whole], past[whole], period[whole]]), axis=1)
        if not rows.shape[1]:
            continue
        # Of equal fragments the smallest period counts; rows are sorted by it.
        least = np.ones(rows.shape[1], bool)
        least[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        rows = rows[:, least]
        np.maximum.at(reach, rows[0], rows[1])
        reach = np.maximum.accumulate(reach)
        at = tile_of[rows[0]]
        kept = k >= low[at]
        found.append((order[at[kept]], rows[2][kept], rows[0][kept] - own[at[kept]], rows[1][kept] - own[at[kept]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tiled(data: np.ndarray, bounds: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, int]]]]:
    """Word hashes of joined rows and their tiles (row, place in the hashes, words, octaves)."""
    for i, j in blocks(bounds):
        starts, ends, rows = word_spans(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        words = span_hashes(data[bounds[i] : bounds[j]], starts, ends)
        cut = np.searchsorted(rows, np.arange(j - i + 1))
        yield words, [(i + r, int(cut[r]), at, n, low, high) for r in range(j - i) for at, n, low, high in octave_tiles(int(cut[r + 1] - cut[r]), base)]


def _batches(tiles: list, words: int = 1 << 18) -> Iterator[list]:
    part, total = [], 0
    for tile in tiles:
        if part and total + tile[3] > words:
            yield part
            part, total = [], 0
        part.append(tile)
        total += tile[3]
    if part:
        yield part


def _near(rows: DataFrame, base: int) -> DataFrame:
    """Fragments of texts solved where they are read."""

    def run(batch):
        data, bounds = text_column(batch.column(2))
        for words, tiles in _tiled(data, bounds, base):
            for part in _batches(tiles):
                cut = np.concatenate([[0], np.cumsum([t[3] for t in part])])
                joined = np.concatenate([words[t[1] + t[2] : t[1] + t[2] + t[3]] for t in part])
                tile, period, first, past = tile_fragments(joined, cut, np.array([t[4] for t in part]), np.array([t[5] for t in part]))
                if len(tile):
                    row, offset = np.array([t[0] for t in part])[tile], np.array([t[2] for t in part])[tile]
                    picked = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(period), pa.array(first + offset), pa.array(past + offset)], ["doc_id", "mark", "period", "first", "past"])

    return arrow_map(rows, FRAGMENT, run)


def _far(rows: DataFrame, base: int) -> DataFrame:
    """Fragments of long texts: their tiles are rows of their own, dealt over the tasks."""

    def explode(batch):
        data, bounds = text_column(batch.column(2))
        for words, tiles in _tiled(data, bounds, base):
            for row, at, offset, n, low, high in tiles:
                packed = pa.array([words[at + offset : at + offset + n].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([offset], pa.int64()), pa.array([low], pa.int32()), pa.array([high], pa.int32()), packed], ["doc_id", "mark", "at", "low", "high", "words"])

    def solve(batch):
        raw = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(5)]
        at, low, high = (batch.column(c).to_numpy() for c in (2, 3, 4))
        for part in _batches([(i, 0, 0, len(w)) for i, w in enumerate(raw)]):
            ids = np.array([t[0] for t in part])
            tile, period, first, past = tile_fragments(np.concatenate([raw[i] for i in ids]), np.concatenate([[0], np.cumsum([t[3] for t in part])]), low[ids], high[ids])
            if len(tile):
                row = ids[tile]
                picked = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(period), pa.array(first + at[row]), pa.array(past + at[row])], ["doc_id", "mark", "period", "first", "past"])

    tiles = arrow_map(rows, "doc_id bigint, mark bigint, at bigint, low int, high int, words binary", explode)
    return arrow_map(tiles.repartition("doc_id", "mark", "at", "low"), FRAGMENT, solve)


def fragments(docs: DataFrame, base: int = TILE_WORDS, spread: int = SPREAD_BYTES) -> DataFrame:
    """doc_id, mark (hash of the text), period, first, past (word behind) of the tiles' fragments."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").where("text is not null")
    long = F.octet_length("text") > spread
    return _near(rows.where(~long), base).union(_far(rows.where(long), base))


def stitched(pieces: DataFrame) -> DataFrame:
    """doc_id, mark, start, length, period of the maximal runs that the fragments make up."""
    key = ["doc_id", "mark", "period"]
    before = W.partitionBy(*key).orderBy("first", "past").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*key).orderBy("first", "past").rowsBetween(W.unboundedPreceding, 0)
    opens = F.coalesce(F.col("first") + F.col("period") > F.max("past").over(before), F.lit(True))
    parts = pieces.distinct().withColumn("opens", opens.cast("int")).withColumn("part", F.sum("opens").over(upto))
    whole = parts.groupBy(*key, "part").agg(F.min("first").alias("start"), F.max("past").alias("past"))
    return whole.groupBy("doc_id", "mark", "start", "past").agg(F.min("period").alias("period")).select("doc_id", "mark", "start", (F.col("past") - F.col("start")).alias("length"), "period")


def periodic_runs(docs: DataFrame, base: int = TILE_WORDS, spread: int = SPREAD_BYTES) -> DataFrame:
    """doc_id, mark (hash of the text), start, length, period of every run of every different text."""
    return stitched(fragments(docs, base, spread))


def collapsed(docs: DataFrame, base: int = TILE_WORDS, spread: int = SPREAD_BYTES) -> DataFrame:
    """doc_id, runs (structs start, length, period, sorted) and kept (words but for repeats of runs) of every row.

    Of each run the first period stays. Only texts that may have runs are moved to meet them.
    """
    found = periodic_runs(docs, base, spread)
    lists = stage(found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "periodic-runs")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    listed = lists.select("mark")

    def keep(batch):
        data, bounds = text_column(batch.column(1))
        runs = batch.column(2)
        kept = []
        for r in range(batch.num_rows):
            words = data[bounds[r] : bounds[r + 1]].tobytes().split()
            own = runs[r].values
            if own is not None and len(own):
                start, period, length = (own.field(c).to_numpy() for c in range(3))
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, start + period, 1)
                np.add.at(steps, start + length, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), runs, pa.array(kept, pa.string())], ["doc_id", "runs", "kept"])

    shape = "array<struct<start:bigint,period:bigint,length:bigint>>"
    maybe = only_listed(rows, "mark", listed)
    met = maybe.join(lists, maybe["doc_id"].eqNullSafe(lists["doc_id"]) & (maybe["mark"] == lists["mark"]), "left").select(maybe["doc_id"], "text", "runs")
    met = arrow_map(met, f"doc_id bigint, runs {shape}, kept string", keep)
    plain = only_listed(rows, "mark", listed, inverse=True).select("doc_id", F.lit(None).cast(shape).alias("runs"), F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).alias("kept"))
    out = met.union(plain)
    return out.select("doc_id", F.transform(F.coalesce("runs", F.array().cast(shape)), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"), "kept")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the tail of one document in ten, by its id, repeats a block of itself."""
    raw = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    words = F.filter(raw, lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).cast("bigint").alias("g"))
    n = F.size("words").cast("bigint")
    chosen = chosen.withColumn("a", F.when(n > 0, F.col("g") % n))
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    a, rest = F.col("a").cast("int"), (n - F.col("a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent and digests of a row of ``collapsed``."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start and period, so only a greater exponent displaces an earlier one.
    best = F.aggregate("runs", none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
