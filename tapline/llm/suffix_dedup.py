"""Suffix-array deduplication of byte passages.

Removes each byte covered by a ``length``-byte string that also starts anywhere else, in the
same document or another.

1. Every window of ``length`` bytes has one anchor: the leftmost smallest hash among its
   first ``length - 100`` positions. Equal windows have their anchor at the same place, so
   only suffixes that begin at anchors (one position in 150) are sorted, and each carries
   the bytes before it that its windows reach back to.
2. Anchors whose next 100 bytes occur once in the corpus, and equal contexts beyond the
   first, need no sorting: counts by hash settle them.
3. The remaining suffixes are range-partitioned by their leading bytes between sampled
   splitters. Each bucket sorts its suffixes, and the reversed bytes before them, by
   multikey quicksort; the longest common prefixes of neighbours on both sides tell for
   every window whether it is repeated in the bucket.
4. Suffix runs that touch the end of a bucket may go on in the next one. Their suffixes are
   compared across boundaries in a second order, range-partitioned by the bytes before the
   anchor; windows that touch the end of a bucket in both orders are counted by content.

Windows that cross a bucket boundary and copied contexts are compared by 128-bit hashes,
everything inside a bucket byte by byte.

Cases: null texts count as empty; texts shorter than ``length`` keep all bytes; repeated
rows and rows with equal or null ids are separate documents; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.llm.common import arrow_map, blocks, mix, only_listed, stage, text_column

LENGTH = 400
#: Bytes from an anchor on that all its windows share.
CORE = 100
GRAM = 16
#: Contexts in one bucket; the number of buckets follows their count.
BUCKET_ROWS = 20_000

_U = np.uint64


def _grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """32-bit hashes of the byte grams that start at every position; short ones at the end are padded."""
    n = len(data)
    wide = np.zeros(n + size, np.uint8)
    wide[:n] = data
    word = np.zeros(n + size, np.uint64)
    for k in range(8):
        word[: n + size - k] |= wide[k:].astype(np.uint64) << _U(8 * k)
    total = mix(word[:n])
    for k in range(8, size, 8):
        total = mix(total + word[k : n + k])
    return total >> _U(32)


def _leftmost_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest key in [s, s + width) for every s with a whole window, leftmost on ties."""
    n = len(keys)
    full = -(-n // width) * width
    packed = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = (keys << _U(32)) | np.arange(n, dtype=np.uint64)
    rows = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _U(0xFFFFFFFF)).astype(np.int64)


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first window start, last window start) of joined rows."""
    if not GRAM <= core <= length:
        raise ValueError("core must hold an anchor's gram and fit into a window")
    width = length - core + 1
    sizes = np.diff(bounds)
    if not len(data) or sizes.max(initial=0) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    place = _leftmost_minima(_grams(data), width)
    starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(bounds[:-1], bounds[1:], strict=True) if e - b >= length])
    rows = np.searchsorted(bounds, starts, "right") - 1
    anchor = place[starts]
    cut = np.ones(len(starts), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts)) - 1
    return rows[first], anchor[first], starts[first], starts[last]


def _hash64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


#: What tells a document: rows with the same id and text lose the same bytes.
KEY = ["doc", "mark"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64("text").alias("mark"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def anchor_rows(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(doc, mark, at, back, near, core, context) per anchor of (doc, mark, text).

    Windows start ``near`` to ``back`` bytes before ``at``; ``core`` hashes the bytes all of
    them share from ``at`` on, ``context`` all bytes that any of them covers, with ``near``
    and ``back``.
    """

    def run(batch):
        doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, bounds = text_column(batch.column(2))
        for i, j in blocks(bounds):
            part, own = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            rows, anchor, first, last = anchors_of(part, own, length, core)
            raw = part.tobytes()
            back, near = anchor - first, anchor - last
            cores = np.array([_hash64(raw[a : a + core]) for a in anchor.tolist()], np.int64)
            contexts = np.array([_hash64(raw[f : e + length] + b"%d,%d" % (x, y)) for f, e, x, y in zip(first.tolist(), last.tolist(), back.tolist(), near.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[i:j][rows]), pa.array(mark[i:j][rows]), pa.array((anchor - own[rows]).astype(np.int32)), pa.array(back.astype(np.int16)), pa.array(near.astype(np.int16)), pa.array(cores), pa.array(contexts)],
                ["doc", "mark", "at", "back", "near", "core", "context"],
            )

    return arrow_map(docs.select(*KEY, "text"), "doc bigint, mark bigint, at int, back smallint, near smallint, core bigint, context bigint", run)


def _contexts(joined: DataFrame, length: int) -> DataFrame:
    """Bytes before and from each wanted anchor on: (core, context, copies, back, near, left, right)."""
    schema = "core bigint, context bigint, copies bigint, back int, near int, left binary, right binary"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ["core", "context", "copies", "back", "near", "left", "right"]

    def run(batch):
        data, bounds = text_column(batch.column(0))
        raw = memoryview(data)
        out: list[tuple] = []
        held = 0
        for k, wanted in enumerate(batch.column(1).to_pylist()):
            base = bounds[k]
            for w in wanted:
                at = base + w["at"]
                out.append((w["core"], w["context"], w["copies"], w["back"], w["near"], bytes(raw[at - w["back"] : at]), bytes(raw[at : at - w["near"] + length])))
                held += w["back"] + length
            if held > 8 << 20 or k == batch.num_rows - 1:
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, held = [], 0

    return arrow_map(joined.select("text", "wanted"), schema, run)


def multikey_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the common prefix lengths of each with the one before it.

    Three-way quicksort on eight bytes at a time; of strings that differ only in trailing
    zero bytes the shorter comes first.
    """
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    words = max(1, -(-int(sizes.max(initial=1)) // 8))
    table = np.zeros((n, 8 * words), np.uint8)
    filled = np.arange(8 * words) < sizes[:, None]
    table[filled] = np.frombuffer(b"".join(strings), np.uint8)
    keys = table.view(">u8").astype(np.uint64)
    order = np.empty(n, np.int64)
    todo = [(np.arange(n), 0, 0)]
    while todo:
        members, depth, at = todo.pop()
        while len(members):
            if len(members) <= 24 or depth == words:
                tail = sorted(members.tolist(), key=lambda m: (keys[m, depth:].tolist(), sizes[m])) if depth < words else members[np.argsort(sizes[members], kind="stable")]
                order[at : at + len(members)] = tail
                break
            word = keys[members, depth]
            pivot = np.partition(word[:: max(1, len(word) // 63)], len(word[:: max(1, len(word) // 63)]) // 2)[len(word[:: max(1, len(word) // 63)]) // 2]
            low, same, high = members[word < pivot], members[word == pivot], members[word > pivot]
            todo.append((low, depth, at))
            todo.append((high, depth, at + len(low) + len(same)))
            members, depth, at = same, depth + 1, at + len(low)
    common = np.zeros(n, np.int64)
    for i in range(1, n, 4096):
        a, b = order[i : i + 4096], order[i - 1 : min(i + 4095, n - 1)]
        unequal = table[a] != table[b]
        first = np.where(unequal.any(axis=1), unequal.argmax(axis=1), 8 * words)
        common[i : i + 4096] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return order, common


def repeated_windows(copies: np.ndarray, back: np.ndarray, near: np.ndarray, left: list[bytes], right: list[bytes], length: int, second: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Which windows of a bucket are repeated, and which touch its ends.

    Returns one (member, reach) of each class of windows in runs that reach the first or last
    suffix (with ``second``, in the order of the bytes before the anchors), and a table
    [member, reach] of repeated windows, ``reach`` being the bytes a window starts before its
    anchor.
    """
    n = len(copies)
    order_r, common_r = multikey_order(right)
    order_l, common_l = multikey_order([x[::-1] for x in left])
    place_r, place_l = np.empty(n, np.int64), np.empty(n, np.int64)
    place_r[order_r], place_l[order_l] = np.arange(n), np.arange(n)
    found = np.zeros((n, int(back.max(initial=0)) + 1), bool)
    edge: list[tuple[int, int]] = []
    for reach in range(int(near.min(initial=0)), int(back.max(initial=0)) + 1):
        active = np.flatnonzero((near <= reach) & (reach <= back))
        if not len(active):
            continue
        run_r = np.cumsum(common_r < length - reach)
        run_l = np.cumsum(common_l < reach)
        r, l = run_r[place_r[active]], run_l[place_l[active]]
        key = r * (n + 1) + l
        sort = np.argsort(key, kind="stable")
        head = np.ones(len(sort), bool)
        head[1:] = key[sort][1:] != key[sort][:-1]
        begin = np.flatnonzero(head)
        total = np.add.reduceat(copies[active][sort], begin)
        found[active[sort], reach] = np.repeat(total > 1, np.diff(np.append(begin, len(sort))))
        leaders = active[sort[begin]]
        run, place = (run_l, place_l) if second else (run_r, place_r)
        open_run = (run[place[leaders]] == run[0]) | (run[place[leaders]] == run[-1])
        edge += [(m, reach) for m in leaders[open_run].tolist()]
    return edge, found


def _runs(row: np.ndarray) -> list[dict]:
    step = np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))
    return [{"low": int(a), "high": int(b) - 1} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def _bucket(length: int, second: bool):
    """Sorts one range partition.

    Rows with ``runs`` tell a context's repeated windows. From the first order come rows with
    ``turned`` (the bytes before the anchor, reversed) for the second; from the second, rows
    with ``window`` for window classes that another bucket may share.
    """
    runs_type = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    kinds = (*(pa.int64(),) * 3, *(pa.int32(),) * 2, *(pa.binary(),) * 3, runs_type, pa.binary(), pa.int32(), pa.bool_())
    names = [x.split()[0] for x in _SORTED.split(", ")]

    def sort(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        core, context, copies, back, near, left, right = (list(c) for c in zip(*rows, strict=True))
        edge, found = repeated_windows(np.array(copies), np.array(back), np.array(near), left, right, length, second)
        none = (None,) * 9
        out = [(core[m], context[m], *none[:6], _runs(found[m]), *none[:3]) for m in np.flatnonzero(found.any(axis=1)).tolist()]
        if second:
            for m, reach in edge:
                window = left[m][len(left[m]) - reach :] + right[m][: length - reach]
                out.append((core[m], context[m], *none[:7], hashlib.blake2b(window, digest_size=16).digest(), reach, bool(found[m, reach])))
        else:
            least: dict[int, int] = {}
            for m, reach in edge:
                least[m] = min(least.get(m, reach), reach)
            out += [(core[m], context[m], copies[m], back[m], reach, left[m], right[m], left[m][::-1], *none[:4]) for m, reach in least.items()]
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 10_000], strict=True), kinds, strict=True)], names)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            # A bucket that came out larger than planned is cut; its parts meet like any two buckets.
            while len(rows) >= 2 * BUCKET_ROWS:
                yield from sort(rows[:BUCKET_ROWS])
                rows = rows[BUCKET_ROWS:]
        if rows:
            yield from sort(rows)

    return run


_HELD = ["core", "context", "copies", "back", "near", "left", "right"]
_SORTED = "core bigint, context bigint, copies bigint, back int, near int, left binary, right binary, turned binary, runs array<struct<low:int,high:int>>, window binary, reach int, repeated boolean"


def _sorted(held: DataFrame, rows: int, order: str, length: int) -> DataFrame:
    buckets = held.repartitionByRange(max(1, -(-rows // BUCKET_ROWS)), order, "context").sortWithinPartitions(order, "context")
    return stage(buckets.select(*_HELD).mapInArrow(_bucket(length, order == "turned"), _SORTED), "suffix-sorted")


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(doc, mark, begin, end): byte spans of (doc, mark, text) made of repeated windows, not merged."""
    anchors = stage(anchor_rows(docs, length, core), "suffix-anchors")
    shared = stage(anchors.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "suffix-cores")
    anchors = stage(anchors.join(shared, "core", "left_semi"), "suffix-shared")
    wanted = anchors.groupBy("core", "context").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "at", "back", "near")).alias("one"))
    wanted = stage(wanted.select("one.*", "core", "context", "copies"), "suffix-wanted")
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("at", "core", "context", "copies", "back", "near")).alias("wanted"))
    held = _contexts(only_listed(docs, "mark", wanted).join(lists, KEY), length)
    first = _sorted(held, wanted.count(), "right", length)
    again = first.where("turned is not null")
    second = _sorted(again, again.count(), "turned", length)

    # A window class found in two buckets of the second order is repeated in both.
    edge = second.where("window is not null").select("core", "context", "window", "reach", "repeated")
    both = edge.groupBy("window", "reach").agg(F.count("*").alias("n")).where("n > 1").select("window", "reach")
    crossing = edge.where("not repeated").join(both, ["window", "reach"]).select("core", "context", F.col("reach").alias("low"), F.col("reach").alias("high"))
    inside = first.union(second).where("runs is not null").select("core", "context", F.explode("runs").alias("run")).select("core", "context", "run.low", "run.high")
    places = anchors.select("core", "context", *KEY, "at").join(inside.union(crossing), ["core", "context"])
    return places.select(*KEY, (F.col("at") - F.col("high")).cast("bigint").alias("begin"), (F.col("at") - F.col("low") + length).cast("bigint").alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs) and ``kept`` (the remaining bytes) of each row."""
    docs = keyed(docs)
    spans = repeated_spans(docs.select(*KEY, "text"), length, core)
    spans = stage(spans.groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "suffix-spans")

    def cut(batch):
        ids, texts, found = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kept, removed, sizes = [], [], []
        for text, own in zip(texts, found, strict=True):
            raw = (text or "").encode()
            whole: list[list[int]] = []
            for begin, end in sorted((x["begin"], x["end"]) for x in own or []):
                if whole and begin <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], end)
                else:
                    whole.append([begin, end])
            edges = [0, *(e for s in whole for e in s), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append([{"begin": a, "end": b} for a, b in whole])
            sizes.append(len(raw))
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    # Documents without repeats need no join.
    touched = only_listed(docs, "mark", spans).join(spans, KEY, "left").select("doc_id", "text", "spans")
    others = only_listed(docs, "mark", spans, inverse=True).select("doc_id", "text", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    return arrow_map(touched.union(others), "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary", cut)
