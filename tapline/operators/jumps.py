"""Greedy walks over numbered rows in many tasks.

A greedy rule that looks ahead and then goes on behind what it took is a jump from every row to
a later one of its key; what it takes are the rows visited from row 0. A chunk of rows is
summarised by where a walk that enters at a row leaves the chunk. Walks from different rows
soon come together, so few rows are ever entered; over those, jumps are doubled, and each chunk
then follows its own walk. A key of any size is thus walked by as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import CHUNK_ROWS, chunk_of


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where a walk from each row leaves the row's chunk; rows come last first."""
    at, known = None, {}
    for pdf in batches:
        out = []
        for key, chunk, i, to, end in zip(pdf.call_id, pdf.chunk, pdf.i, pdf.to, pdf.end):
            if (key, chunk) != at:
                at, known = (key, chunk), {}
            known[i] = known.get(to, to) if to < end else to
            out.append(known[i])
        yield pdf[["call_id", "chunk", "i"]].assign(exit=out)


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each chunk that the walk entering it visits."""
    at, due = None, None
    for pdf in batches:
        out = []
        for key, chunk, i, to, entry in zip(pdf.call_id, pdf.chunk, pdf.i, pdf.to, pdf.entry):
            if (key, chunk) != at:
                at, due = (key, chunk), entry
            if i == due:
                out.append((key, i))
                due = to
        yield pd.DataFrame(out, columns=["call_id", "i"])


def visited(rows: DataFrame, keep: Callable[[str, DataFrame], DataFrame], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(call_id, i) of the rows on the walk from row 0 of each call.

    ``rows``: call_id, i (dense from 0) and to, the row that follows i, behind the last one at
    the end. ``keep`` stores a table.
    """
    rows = keep("jumps", rows.select("call_id", "i", "to", chunk_of("i", chunk_rows).alias("chunk")))
    ends = rows.withColumn("end", (F.col("chunk") + 1) * chunk_rows)
    exits = ends.repartition("call_id", "chunk").sortWithinPartitions("call_id", "chunk", F.desc("i")).mapInPandas(
        _exits, "call_id string, chunk bigint, i bigint, exit bigint"
    )
    exits = keep("jump_exits", exits)
    # Rows at which some chunk may be entered, with where the walk enters the next one.
    entered = exits.select("call_id", F.col("exit").alias("i")).distinct().unionByName(exits.where("i = 0").select("call_id", "i")).distinct()
    nodes = keep("jump_nodes", exits.join(entered, ["call_id", "i"]).select("call_id", "chunk", "i", "exit"))
    jump = nodes.join(nodes.select("call_id", F.col("i").alias("exit"), F.lit(True).alias("_there")), ["call_id", "exit"]).select(
        "call_id", "i", F.col("exit").alias("to")
    )
    levels, k = [], 0
    while True:
        jump = keep(f"jump_{k}", jump)
        if jump.isEmpty():
            break
        levels.append(jump)
        jump = jump.join(jump.select("call_id", F.col("i").alias("to"), F.col("to").alias("far")), ["call_id", "to"]).select("call_id", "i", F.col("far").alias("to"))
        k += 1
    reached = nodes.where("i = 0").select("call_id", "i")
    for level in reversed(levels):
        reached = reached.unionByName(reached.join(level, ["call_id", "i"]).select("call_id", F.col("to").alias("i")))
    entries = reached.join(nodes, ["call_id", "i"]).select("call_id", "chunk", F.col("i").alias("entry"))
    walked = rows.join(entries, ["call_id", "chunk"]).select("call_id", "chunk", "i", "to", "entry")
    return walked.repartition("call_id", "chunk").sortWithinPartitions("call_id", "chunk", "i").mapInPandas(_followed, "call_id string, i bigint")
