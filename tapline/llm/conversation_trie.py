"""Prefix trie of conversations, totals of subtrees by time-forward processing.

A node of depth d stands for a distinct sequence of the first d turns (role, text); the
conversations that begin with it are its members, the smallest id among them names it.

1. Turns are reduced to a digest and a word count, numbered, and every prefix gets two 64-bit
   path hashes: the running XOR of hashes of (place, digest). A grouped aggregate makes nodes
   of them, so that an opening shared by a third of all conversations is combined before it moves.
2. A node's (smallest member, depth) is its key, and with it the shard: ``BLOCK`` ids and
   ``BAND`` levels. Nodes of a shard are sorted by reverse level order by Spark's external
   sort. One pass over them sends every node's subtree totals to its parent through a priority
   queue ordered like the nodes, so a parent finds the messages of all children on top. A queue
   holds ``QUEUE_MESSAGES``; what comes beyond is spilled to the exchange and reaches its parent
   like the messages of other shards.
3. Nodes whose parent is elsewhere are shard roots. Their messages are added up by receiver; a
   pass downwards finds the receiver that a receiver's own shard root reports to, and doubling
   along these links carries the totals across shard roots in a logarithmic number of rounds.
4. A second pass upwards, with what arrived from outside, gives the totals of all nodes.
5. The ids of conversations that end at a node are hashed in order: ranges of ids are joined
   into pieces where they are, and a node's pieces are streamed through the digest.

Cases: turns come by ``turn``, null first, equal ones by the digest of role and text; a null
role or text is empty; rows without a conv_id belong to no conversation; a repeated row is a
turn of its own; an empty table gives no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapline.llm.common import joined_by_key, stage
from tapline.operators.ordering import CHUNK_ROWS, chunk_of, dense_index

#: Conversation ids and levels of a shard.
BLOCK = 4096
BAND = 4096
#: Messages a shard's queue holds.
QUEUE_MESSAGES = 1 << 16
#: Ids in one piece of a node's list of ids.
PIECE_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"
PATH = ["depth", "p1", "p2"]
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, own bigint, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    turns = turns.withColumn("chunk", F.coalesce(chunk_of("turn"), F.lit(-(1 << 62))))
    return dense_index(turns, ["conv_id"], "chunk", ["turn", "digest"], "place").select("conv_id", "place", "digest", "words")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and all conversations (conv_id, whether it has no turn).

    A conversation takes its first turns, as many as its id's checksum says, from the one whose
    id is the next lower multiple of ``every``.
    """
    turns = stage(turns, "trie-numbered")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    heads = turns.where(F.col("place") < most).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    convs = convs.withColumns({"cut": F.crc32(F.col("conv_id").cast("string")) % (most + 1), "base": F.col("conv_id") - F.col("conv_id") % every})
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("cut").cast("int"))
    plans = stage(convs.join(heads, "base", "left").select("conv_id", "turns", "cut", head.alias("head")), "trie-plans")
    sizes = plans.select("conv_id", F.col("turns").alias("n"))
    own = joined_by_key(turns, plans.select("conv_id", "cut", F.size("head").alias("taken")), "conv_id", sizes).where("place >= cut")
    own = own.select("conv_id", (F.col("place") - F.col("cut") + F.col("taken")).alias("place"), "digest", "words")
    opened = plans.select("conv_id", F.explode("head").alias("turn")).select("conv_id", "turn.place", "turn.digest", "turn.words")
    return own.union(opened), plans.select("conv_id", ((F.size("head") == 0) & (F.col("turns") <= F.col("cut"))).alias("empty"))


def paths(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, depth, words, path hashes p1 and p2 of every prefix, and those of its parent (q1, q2)."""
    x = {"x1": F.xxhash64("place", "digest"), "x2": F.xxhash64(F.lit("trie"), "digest", "place")}
    rows = turns.withColumns(x).withColumn("chunk", chunk_of("place", chunk_rows))
    total = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = total.select("conv_id", "chunk", F.bit_xor("t1").over(before).alias("c1"), F.bit_xor("t2").over(before).alias("c2")).where("chunk > 0")
    upto = W.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    inner = rows.repartition("conv_id", "chunk").select("conv_id", "chunk", "place", "words", "x1", "x2", F.bit_xor("x1").over(upto).alias("s1"), F.bit_xor("x2").over(upto).alias("s2"))
    whole = inner.join(carry, ["conv_id", "chunk"], "left")
    p1, p2 = (F.col(f"s{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))) for k in (1, 2))
    return whole.select("conv_id", (F.col("place") + 1).alias("depth"), "words", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("x1")).alias("q1"), p2.bitwiseXOR(F.col("x2")).alias("q2"))


def _ids(rows: Iterator[tuple], size: int) -> Iterator[tuple]:
    key, first, ids = None, None, []
    for *path, conv_id in rows:
        if path != key or len(ids) == size:
            if ids:
                yield (*key, first, ",".join(ids))
            key, first, ids = path, conv_id, []
        ids.append(str(conv_id))
    if ids:
        yield (*key, first, ",".join(ids))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _written(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in text.split(","))])


def end_digests(ends: DataFrame, size: int = PIECE_IDS) -> DataFrame:
    """depth, p1, p2, ends_sha256: SHA-256 of the ascending ids that end at a node, joined by commas."""
    pieces_of = "depth bigint, p1 bigint, p2 bigint, first bigint, ids string"
    digest_of = "depth bigint, p1 bigint, p2 bigint, ends_sha256 string"

    def cut(batches):
        yield from _written(_ids(_rows(batches), size), _schema(pieces_of))

    def digest(batches):
        def hashed():
            key, state = None, None
            for *path, _, ids in _rows(batches):
                if path != key:
                    if state:
                        yield (*key, state.hexdigest())
                    key, state = path, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if state:
                yield (*key, state.hexdigest())

        yield from _written(hashed(), _schema(digest_of))

    ranges = ends.select(*PATH, "conv_id").repartitionByRange("conv_id").sortWithinPartitions(*PATH, "conv_id")
    pieces = ranges.mapInArrow(cut, pieces_of)
    return pieces.repartition(*PATH).sortWithinPartitions(*PATH, "first").mapInArrow(digest, digest_of)


def nodes(turns: DataFrame, convs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The nodes with their parents and own numbers (schema ``NODE``); the root's parent is null."""
    found = stage(paths(turns, chunk_rows), "trie-paths")
    convs = stage(convs, "trie-conversations")
    made = found.groupBy(*PATH).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("words"), F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"))
    made = stage(made.union(root), "trie-nodes")
    children = stage(made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n")), "trie-children")
    last = found.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("last")).select("last.*", "conv_id")
    ends = stage(last.union(convs.where("empty").select(zero, zero, zero, "conv_id")), "trie-ends")
    rows = made.join(children, PATH, "left").join(end_digests(ends), PATH, "left")
    none = hashlib.sha256(b"").hexdigest()
    rows = rows.select(*PATH, "q1", "q2", "conv_id", "n_convs", F.coalesce("n", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    rows = stage(rows, "trie-rows")
    above = rows.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    sizes = children.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n")
    below = joined_by_key(rows.where("depth > 0"), above, ["depth", "q1", "q2"], sizes)
    names = [c.split()[0] for c in NODE.split(", ")]
    top = rows.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return below.select(*names).union(top.select(*names))


def _shard(rows: DataFrame, columns: list[str], block: int, band: int) -> DataFrame:
    """Columns of ``rows`` with the shard's block of ids and band of levels; a shard is whole in one partition."""
    at = [F.floor(F.col("conv_id") / block).alias("block"), F.floor(F.col("depth") / band).alias("band")]
    return rows.select(*columns, *at).repartition("block", "band")


def _inside(conv_id: int, depth: int, parent: int | None, block: int, band: int) -> bool:
    return parent is not None and parent // block == conv_id // block and (depth - 1) // band == depth // band


UPWARDS = "conv_id bigint, depth bigint, parent_conv_id bigint, leaves bigint, saved bigint, out boolean"


def _upwards(rows: DataFrame, block: int, band: int, queue_messages: int) -> DataFrame:
    """Subtree totals inside the shards, bottom up; ``out`` tells which nodes report outside.

    ``rows``: conv_id, depth, parent_conv_id, leaves, saved (own numbers), out (null: decided here).
    """

    def passed(batches):
        shard, queue = None, []
        for conv_id, depth, parent, leaves, saved, out, *at in _rows(batches):
            if at != shard:
                assert not queue
                shard, queue = at, []
            while queue and queue[0][:2] == (-depth, conv_id):
                _, _, more, tokens = heapq.heappop(queue)
                leaves, saved = leaves + more, saved + tokens
            if out is None:
                out = not _inside(conv_id, depth, parent, block, band) or len(queue) >= queue_messages
            if not out:
                heapq.heappush(queue, (1 - depth, parent, leaves, saved))
            yield conv_id, depth, parent, leaves, saved, out
        assert not queue

    def run(batches):
        yield from _written(passed(batches), _schema(UPWARDS))

    placed = _shard(rows, ["conv_id", "depth", "parent_conv_id", "leaves", "saved", "out"], block, band)
    return placed.sortWithinPartitions("block", "band", F.desc("depth"), "conv_id").mapInArrow(run, UPWARDS)


EXITS = "conv_id bigint, depth bigint, next_conv_id bigint, next_depth bigint"


def _exits(rows: DataFrame, block: int, band: int) -> DataFrame:
    """The node outside that the shard root above each node reports to, top down (null: none)."""

    def passed(batches):
        shard, level, above, own = None, None, {}, {}
        for conv_id, depth, parent, out, *at in _rows(batches):
            if at != shard:
                shard, level, above, own = at, depth, {}, {}
            elif depth != level:
                above, own, level = own if depth == level + 1 else {}, {}, depth
            target = above[parent] if not out else (parent, depth - 1) if parent is not None else (None, None)
            own[conv_id] = target
            yield conv_id, depth, *target

    def run(batches):
        yield from _written(passed(batches), _schema(EXITS))

    return _shard(rows, ["conv_id", "depth", "parent_conv_id", "out"], block, band).sortWithinPartitions("block", "band", "depth", "conv_id").mapInArrow(run, EXITS)


def _across(received: DataFrame) -> DataFrame:
    """Totals that reach every receiver from outside, over chains of shard roots of any length.

    ``received``: conv_id, depth, leaves, saved, next_conv_id, next_depth. After k rounds a row
    holds the totals of all receivers less than 2^k links below it and links to the one 2^k above.
    """
    key, after = ["conv_id", "depth"], ["next_conv_id", "next_depth"]
    while received.where("next_conv_id is not null").limit(1).count():
        moving = received.where("next_conv_id is not null")
        sums = moving.groupBy(*after).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("tokens"), F.count("*").alias("n"))
        jumps = received.select(F.col("conv_id").alias("next_conv_id"), F.col("depth").alias("next_depth"), F.col("next_conv_id").alias("far_conv_id"), F.col("next_depth").alias("far_depth"))
        far = joined_by_key(moving, jumps, after, sums.select(*after, "n")).select(*key, "leaves", "saved", F.col("far_conv_id").alias("next_conv_id"), F.col("far_depth").alias("next_depth"))
        rows = far.union(received.where("next_conv_id is null").select(*far.columns))
        sums = sums.select(F.col("next_conv_id").alias("conv_id"), F.col("next_depth").alias("depth"), "more", "tokens")
        zero = F.lit(0).cast("bigint")
        received = stage(rows.join(sums, key, "left").select(*key, (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("saved") + F.coalesce("tokens", zero)).alias("saved"), *after), "trie-across")
    return received


def with_totals(tree: DataFrame, block: int = BLOCK, band: int = BAND, queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """Rows of ``nodes`` with n_leaves and saved_tokens of their subtrees."""
    tree = stage(tree, "trie-tree")
    key, zero = ["conv_id", "depth"], F.lit(0).cast("bigint")
    own = tree.select(*key, "parent_conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), F.col("own").alias("saved"), F.lit(None).cast("boolean").alias("out"))
    local = stage(_upwards(own, block, band, queue_messages), "trie-local")
    sent = local.where("out and parent_conv_id is not null")
    received = sent.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    received = _across(stage(received.join(_exits(local, block, band), key), "trie-received"))
    received = received.select(*key, F.col("leaves").alias("more"), F.col("saved").alias("tokens"))
    met = own.drop("out").join(local.select(*key, "out"), key).join(received, key, "left")
    whole = _upwards(met.select(*key, "parent_conv_id", (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("saved") + F.coalesce("tokens", zero)).alias("saved"), "out"), block, band, queue_messages)
    return tree.join(whole.select(*key, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), key)


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, band: int = BAND, queue_messages: int = QUEUE_MESSAGES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` is as from ``numbered``; ``convs`` names all conversations (conv_id, empty: has no turn).
    """
    found = with_totals(nodes(turns, convs, chunk_rows), block, band, queue_messages)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
