"""Histogram-sort sharding, in DataFrame functions only.

Rows are ordered by a hash of their text, so equal texts stand together. The bytes below
candidate boundaries are counted exactly over all partitions; the cell that holds a shard's
target is cut again until a boundary meets the tolerance. Only counts of candidate cells
reach the driver. One exchange then brings the rows of each shard together.

Groups of equal texts too large for the tolerance are placed first, each whole in the shard
with most room; only a group that no shard has room for is spread over its rows' own hashes.

Laws: ``bytes`` (sizes near equal), ``rows`` (counts at most one apart), ``key`` (the id and
the number of shards decide; a further shard takes rows only into itself).

Cases: null texts count as empty (size 1); repeated rows and rows with equal or null ids are
placed each; an empty table gives no rows; more shards than groups leave shards empty; other
columns are passed on in ``row`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.llm.common import stage

SHARDS = 8
#: Bytes off a target that end the search, and bytes of a group that is placed by itself, in shares of a shard.
TOLERANCE, LARGE_GROUP = 0.0005, 0.005
#: Candidate boundaries in a cell at a time; a power of two.
PROBES = 512
_SPACE = 1 << 62
_CELL_ROWS = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, size, text_crc32, group (hash of the text) and own (hash of id and text)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("bigint")
    half = lambda h: h.bitwiseAND(F.lit(_SPACE - 1))
    return docs.select(
        F.struct("*").alias("row"), doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        half(F.xxhash64(text)).alias("group"), half(F.xxhash64(doc_id, text)).alias("own"),
    )


def _cells(table: DataFrame, cells: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Bytes in each of ``PROBES`` parts of the cells (first position, width), counted over all rows."""
    number, part = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k, (low, width) in enumerate(cells):
        inside = (F.col("place") >= low) & (F.col("place") < low + width)
        number = F.when(inside, F.lit(k)).otherwise(number)
        part = F.when(inside, F.expr(f"(place - {low}L) div {max(1, width // PROBES)}L")).otherwise(part)
    rows = table.select(number.alias("cell"), part.alias("part"), "size").where("cell is not null").groupBy("cell", "part").agg(F.sum("size").alias("size")).collect()
    return {(r["cell"], r["part"]): r["size"] for r in rows}


def splitters(table: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """Positions with about ``targets`` bytes below them, of a table (place, size) with 0 <= place < 2**62.

    Each search ends within the tolerance, or where a single position holds more bytes.
    """
    found: dict[int, int] = {}
    search = {k: (0, _SPACE, 0) for k in range(len(targets))}  # cell and the bytes below it
    while search:
        cells = sorted({(low, width) for low, width, _ in search.values()})
        counts = _cells(table, cells)
        for k, (low, width, below) in list(search.items()):
            c, step, total = cells.index((low, width)), max(1, width // PROBES), below
            part, inside = -1, 0
            for part in range(width // step):
                inside = counts.get((c, part), 0)
                if total + inside >= targets[k]:
                    break
                total += inside
            begin = low + part * step
            under, over = targets[k] - total, total + inside - targets[k]
            if min(under, over) <= tolerance or step == 1:
                found[k] = begin if under <= over else begin + step
                del search[k]
            else:
                search[k] = (begin, step, total)
    return [found[k] for k in range(len(targets))]


def _room(large: list[tuple[int, int]], shards: int, capacity: float, slack: float) -> tuple[dict[int, int], list[float]]:
    """Shards of the large groups (largest first, to the emptiest shard) and what each shard has left."""
    left = [capacity] * shards
    placed = {}
    for group, size in sorted(large, key=lambda g: (-g[1], g[0])):
        s = max(range(shards), key=lambda s: (left[s], -s))
        if size <= left[s] + slack:
            placed[group] = s
            left[s] -= size
    return placed, left


def _lookup(values: dict[int, int], key: Column, frame: DataFrame) -> DataFrame:
    """``frame`` with ``fixed``, the shard of a large group; there are at most shards / LARGE_GROUP of them."""
    spark = frame.sparkSession
    table = spark.createDataFrame([(g, s) for g, s in values.items()], "fixed_group bigint, fixed int")
    return frame.join(F.broadcast(table), key == F.col("fixed_group"), "left").drop("fixed_group")


def _numbered(frame: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """``slot``: gapless from 0 within ``by``, by (cell, spread), with one exchange of the rows."""
    before = Window.partitionBy(*by).orderBy("cell", "spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "cell", "spread", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*by, "cell", "spread").orderBy("order_in_cell", "doc_id")
    rows = frame.withColumn("rank", F.row_number().over(within))
    return rows.join(offsets, [*by, "cell", "spread"]).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("bigint"))


def by_key(doc_id: Column, shards: int) -> Column:
    """The shard with the highest hash of id and shard; a further shard only takes what it wins."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(doc_id, s).alias("score"), s.alias("shard")))
    return F.array_max(scores)["shard"].cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """row, doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    rows = sized(docs)
    known = stage(rows.select("doc_id", "size", "group", "own"), "shard-known")
    total = known.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("rows")).first()
    # Cells of about so many rows, at least 16; ``spread`` cuts the rows of a large group.
    bits = max(4, math.ceil(math.log2(max(1, total["rows"] / _CELL_ROWS))))
    narrow = F.shiftright("place", 62 - bits)

    if law == "bytes":
        capacity = total["size"] / shards
        groups = known.groupBy("group").agg(F.sum("size").alias("size"))
        large = [(r["group"], r["size"]) for r in groups.where(F.col("size") > max(capacity * LARGE_GROUP, 1)).collect()]
        placed, left = _room(large, shards, capacity, capacity * LARGE_GROUP)
        spread_out = {g: -1 for g, _ in large if g not in placed}

        def located(frame: DataFrame) -> DataFrame:
            frame = _lookup(placed | spread_out, F.col("group"), frame)
            return frame.withColumn("place", F.when(F.col("fixed") == -1, F.col("own")).otherwise(F.col("group")))

        targets = [sum(left[: s + 1]) for s in range(shards - 1)]
        free = located(known).where("fixed is null or fixed = -1").select("place", "size")
        cuts = splitters(stage(free, "shard-free"), targets, capacity * TOLERANCE)
        beyond = sum((F.when(F.col("place") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))

        def assigned(frame: DataFrame) -> DataFrame:
            frame = located(frame)
            fixed = F.col("fixed").isNotNull() & (F.col("fixed") >= 0)
            return frame.withColumns({
                "shard": F.when(fixed, F.col("fixed")).otherwise(beyond).cast("int"), "cell": narrow,
                "spread": F.when(F.col("fixed").isNotNull(), F.shiftright("own", 62 - bits)).otherwise(F.lit(0).cast("bigint")),
            })
    elif law in ("rows", "key"):

        def assigned(frame: DataFrame) -> DataFrame:
            shard = by_key(F.col("doc_id"), shards) if law == "key" else F.lit(0)
            return frame.withColumn("place", F.col("own")).withColumns({"shard": shard, "cell": narrow, "spread": F.lit(0).cast("bigint")})
    else:
        raise ValueError(f"no such law: {law}")

    counts = assigned(known).groupBy("shard", "cell", "spread").agg(F.count("*").alias("n"))
    out = _numbered(assigned(rows).withColumn("order_in_cell", F.col("own")), counts, ["shard"])
    if law == "rows":
        # One gapless order over all rows, cut into equal parts.
        n, part = max(1, total["rows"]), F.expr(f"cast((slot * {shards}L) div {max(1, total['rows'])}L as int)")
        first = F.expr(f"(cast(shard as bigint) * {n}L + {shards - 1}L) div {shards}L")
        out = out.withColumn("shard", part).withColumn("slot", F.col("slot") - first)
    grown = by_key(F.col("doc_id"), shards + 1) if law == "key" else F.lit(None).cast("int")
    return out.select("row", "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", grown.alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "bytes") -> None:
    """Write ``docs`` in folders ``shard=N``, each file in slot order; the rows keep their columns in ``row``."""
    out = sharded(docs, shards, law).select("row", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
