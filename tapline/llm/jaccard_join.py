"""N-gram Jaccard join with count-vector R-trees.

Two texts link when their sets of three-word shingles have 100 * |x & y| >= 90 * |x | y|.

1. Equal sets are one node (``sid``), so copies cost one row however many there are.
2. The shingles of a set are hashed into groups whose number grows with the size of the set,
   so that a linked pair (which differs in few shingles) has some group of exactly equal
   shingles: sets that share no group can't link, and none that link are missed. Sets of up
   to ``PREFIX_SIZE`` shingles meet on their smallest shingles instead.
3. Every set that shares a group with others is first compared with the most central set it
   meets; most clusters come together in these stars.
4. Groups that still hold several components are searched with an R-tree over count vectors
   (points of ``AXES`` group counts): the overlap of two sets is at most the sum of their
   coordinate minima, and of a set and a tree node the sum against the node's upper corner.
   Finer vectors check what the tree lets through.
5. Surviving pairs are verified on the whole sets; components of the verified links follow.

Shingles and sets are compared through 64-bit hashes.

Cases: null, empty and blank texts have no shingles, link with nothing and are their own
component; a text of one or two words has one shingle; repeated rows and null ids keep their
rows (``component_id`` ignores null ids, and is the row's own id where a text has no words);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.llm.common import arrow_map, blocks, connected, discard, lower_ascii, mix, only_listed, shingle_hashes, span_hashes, stage, text_column, word_spans

SHINGLE = 3
#: Least similarity in hundredths.
PERCENT = 90
#: Sets up to this size meet on their smallest shingles.
PREFIX_SIZE = 80
ZONE_STEP = 1.4
AXES = 32
LEAF = 64
#: Axes of the finer vectors that check what the tree lets through.
FINE_LEAST, FINE_MOST = 64, 2048
STAR_ROUNDS = 2
#: Sets a task remembers, so that the keys of copies it meets are given out once.
REMEMBERED = 1 << 18
#: Members of a group that one task compares with as many others.
BLOCK_MEMBERS = 2_000

_U = np.uint64
_ZONES = [PREFIX_SIZE]
while _ZONES[-1] < 1 << 40:
    _ZONES.append(int(_ZONES[-1] * ZONE_STEP))
_EDGES = np.array(_ZONES, np.int64)


def _most_apart(size: np.ndarray) -> np.ndarray:
    """Most shingles in which linked sets of at most ``size`` shingles can differ."""
    union = 200 * size // (100 + PERCENT)
    return (100 - PERCENT) * union // 100


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of joined rows, sorted by row and hash."""
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    hashes, at = shingle_hashes(words, rows, size)
    counts = np.bincount(rows, minlength=len(bounds) - 1)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        first = np.searchsorted(rows, few)
        total = np.full(len(few), size, np.uint64)
        for k in range(size - 1):
            inside = counts[few] > k
            total[inside] = mix(total[inside] + words[first[inside] + k] * _U(2 * k + 3))
        hashes, at = np.concatenate([hashes, mix(total + counts[few].astype(np.uint64))]), np.concatenate([at, few])
    order = np.lexsort((hashes, at))
    hashes, at = hashes[order], at[order]
    keep = np.ones(len(at), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1])
    return hashes[keep], at[keep]


def group_keys(hashes: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the meeting keys of each set; ``n`` holds the size of each row's set."""
    first = np.cumsum(n) - n
    keys, at = [], []
    # Small sets: with the smallest shingles first, linked sets share one of so many.
    prefix = np.where(n <= PREFIX_SIZE, n - -(-PERCENT * n // 100) + 1, 0)
    chosen = np.arange(len(rows)) - first[rows] < prefix[rows]
    keys.append(mix(hashes[chosen] ^ _U(0x51ED270B)))
    at.append(rows[chosen])
    # Larger sets: in the zone of their size and in the one of the largest set they can link with.
    own, top = np.searchsorted(_EDGES, n), np.searchsorted(_EDGES, 100 * n // PERCENT)
    for zone in (own, np.where(top > own, top, 0)):
        groups = (1.2 * (_most_apart(_EDGES[zone]) + 1) + 3).astype(np.int64)
        taken = (zone > 0)[rows]
        h, r = hashes[taken], rows[taken]
        if len(h):
            g = ((h >> _U(32)) * groups[r].astype(np.uint64)) >> _U(32)
            cut = np.ones(len(h), bool)
            cut[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
            begin = np.flatnonzero(cut)
            total = np.add.reduceat(mix(h), begin)
            keys.append(mix(total + g[begin] * _U(0x9E3779B97F4A7C15) + zone[r[begin]].astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))
            at.append(r[begin])
    return np.concatenate(keys), np.concatenate(at)


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Values sorted by row as one list a row."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64).view(np.int64)))


def _set_ids(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    cut = np.concatenate([[0], np.cumsum(n)])
    return np.array([int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, sid, point (count vector), keys (groups) of every row.

    Of equal sets that a task meets only the first has keys, so a large group of copies has no
    more rows of a key than there are tasks.
    """
    seen: set[int] = set()

    def fresh(sids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sids), bool)
        for k, sid in enumerate(sids.tolist()):
            if sid not in seen:
                out[k] = True
                seen.add(sid)
        if len(seen) > REMEMBERED:
            seen.clear()
        return out

    def run(batch):
        data, bounds = text_column(batch.column(2))
        for i, j in blocks(bounds):
            hashes, rows = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], size)
            m = j - i
            n = np.bincount(rows, minlength=m)
            point = np.bincount(rows * AXES + (hashes & _U(AXES - 1)).astype(np.int64), minlength=m * AXES)
            keys, at = group_keys(hashes, rows, n)
            sids = _set_ids(hashes, n)
            given = fresh(sids)[at]
            keys, at = keys[given], at[given]
            order = np.argsort(at, kind="stable")
            axes = pa.ListArray.from_arrays(pa.array(np.arange(0, m * AXES + 1, AXES, dtype=np.int32)), pa.array(point.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), batch.column(1).slice(i, m), pa.array(n), pa.array(sids), axes, _lists(keys[order], at[order], m)], ["doc_id", "mark", "n_shingles", "sid", "point", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return arrow_map(rows, "doc_id bigint, mark bigint, n_shingles bigint, sid bigint, point array<int>, keys array<bigint>", run)


def possible(na, nb, shared):
    """Whether sets of these sizes with at most ``shared`` common shingles can link (columns or arrays)."""
    return (100 + PERCENT) * shared >= PERCENT * (na + nb)


class CountTree:
    """R-tree of count vectors, loaded by cutting along the widest axis.

    A node keeps the upper corner of its points and the least size; a search leaves out nodes
    whose summed coordinate minima can't reach the needed overlap.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes = points, points.sum(axis=1)
        self.nodes: list[tuple[np.ndarray, int, np.ndarray | None, int, int]] = []
        if len(points):
            self._load(np.arange(len(points)), leaf)

    def _load(self, members: np.ndarray, leaf: int) -> int:
        own, at = self.points[members], len(self.nodes)
        self.nodes.append((own.max(axis=0), int(self.sizes[members].min()), None, -1, -1))
        if len(members) <= leaf:
            self.nodes[at] = (*self.nodes[at][:2], members, -1, -1)
            return at
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order = members[np.argsort(own[:, axis], kind="stable")]
        left = self._load(order[: len(order) // 2], leaf)
        right = self._load(order[len(order) // 2 :], leaf)
        self.nodes[at] = (*self.nodes[at][:2], None, left, right)
        return at

    def search(self, point: np.ndarray) -> np.ndarray:
        """Members that can link with ``point``."""
        size, found, todo = int(point.sum()), [], [0] if self.nodes else []
        while todo:
            upper, least, members, left, right = self.nodes[todo.pop()]
            if not possible(size, least, int(np.minimum(upper, point).sum())):
                continue
            if members is None:
                todo += [left, right]
            else:
                shared = np.minimum(self.points[members], point).sum(axis=1)
                found.append(members[possible(size, self.sizes[members], shared)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _fine(hashes: np.ndarray) -> bytes:
    """A finer count vector with about an axis for two shingles; halves of it add up to the coarser ones."""
    axes = FINE_LEAST
    while axes < min(len(hashes) // 2, FINE_MOST):
        axes *= 2
    counts = np.bincount((hashes & _U(axes - 1)).astype(np.int64), minlength=axes)
    wide = counts.max(initial=0) > 255
    return bytes([4 if wide else 1]) + counts.astype(np.uint32 if wide else np.uint8).tobytes()


def _read_fine(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if raw[0] == 4 else np.uint8, offset=1).astype(np.int64)


def _folded(vectors: np.ndarray, axes: int) -> np.ndarray:
    return vectors.reshape(*vectors.shape[:-1], -1, axes).sum(axis=-2)


class _FineCheck:
    """Bounds of the finer vectors, by their number of axes."""

    def __init__(self, raw: list[bytes]):
        vectors = [_read_fine(x) for x in raw]
        self.axes = np.array([len(v) for v in vectors], np.int64)
        self.place = np.zeros(len(vectors), np.int64)
        self.by_axes = {}
        for axes in set(self.axes.tolist()):
            own = np.flatnonzero(self.axes == axes)
            self.place[own] = np.arange(len(own))
            self.by_axes[axes] = np.stack([vectors[k] for k in own])

    def passing(self, members: np.ndarray, query: np.ndarray) -> np.ndarray:
        kept, size = [], int(query.sum())
        for axes, table in self.by_axes.items():
            own = members[self.axes[members] == axes]
            if not len(own):
                continue
            least = min(axes, len(query))
            near, q = _folded(table[self.place[own]], least), _folded(query, least)
            kept.append(own[possible(size, near.sum(axis=1), np.minimum(near, q).sum(axis=1))])
        return np.concatenate(kept) if kept else members[:0]


def _search_block(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components that the bounds let through, for one pair of blocks."""
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left = group[group["block"] == i].drop_duplicates("sid")
    right = left if i == j else group[group["block"] == j].drop_duplicates("sid")
    tree = CountTree(np.array(left["point"].tolist(), np.int64).reshape(-1, AXES))
    fine = _FineCheck(left["fine"].tolist())
    sids, components = left["sid"].to_numpy(), left["component"].to_numpy()
    a, b = [], []
    for sid, component, point, own in zip(right["sid"], right["component"], right["point"], right["fine"], strict=True):
        near = tree.search(np.asarray(point, np.int64))
        near = near[(components[near] != component) & ((sids[near] < sid) | (i != j))]
        near = fine.passing(near, _read_fine(own))
        a.append(np.minimum(sids[near], sid))
        b.append(np.maximum(sids[near], sid))
    return pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}, dtype="int64")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and summed coordinate minima allow."""
    left = nodes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    right = nodes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    shared = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return pairs.join(left, "a").join(right, "b").where(possible(F.col("na"), F.col("nb"), F.least("na", "nb"))).where(possible(F.col("na"), F.col("nb"), shared)).select("a", "b")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """sid, shingles and fine vector of the ``wanted`` nodes (sid, rep).

    The texts are read once more; a bit filter of fixed size leaves out most documents that
    stand for no wanted node before their sets are built.
    """

    def run(batch):
        data, bounds = text_column(batch.column(1))
        for i, j in blocks(bounds):
            hashes, at = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], size)
            n = np.bincount(at, minlength=j - i)
            cut = np.concatenate([[0], np.cumsum(n)])
            fine = pa.array([_fine(hashes[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(_set_ids(hashes, n)), fine, _lists(hashes, at, j - i)], ["rep", "sid", "fine", "shingles"])

    again = only_listed(docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text"), "rep", wanted)
    sets = arrow_map(again, "rep bigint, sid bigint, fine binary, shingles array<bigint>", run)
    known = (sets["sid"] == wanted["sid"]) & sets["rep"].eqNullSafe(wanted["rep"])
    return sets.join(wanted, known, "left_semi").groupBy("sid").agg(F.first("fine").alias("fine"), F.first("shingles").alias("shingles"))


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link; of the sets, only those of either side are moved."""

    def side(name: str) -> DataFrame:
        ids = pairs.select(F.col(name).alias("sid")).distinct()
        return only_listed(sets.select("sid", "shingles"), "sid", ids).select(F.col("sid").alias(name), F.col("shingles").alias(f"s{name}"))

    left, right = side("a"), side("b")

    def compare(batch):
        def flat(column):
            return column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()

        (x, xo), (y, yo) = flat(batch.column(2)), flat(batch.column(3))
        good = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            s, t = x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]]
            shared = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            good[k] = 100 * shared >= PERCENT * (len(s) + len(t) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(good))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return arrow_map(joined, "a bigint, b bigint", compare)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The distinct rows (key, sid) whose key several sets have, in one exchange.

    Rows are range-partitioned by key and set, so a frequent key is cut over tasks; a row stays
    if a neighbour has its key. At the ends of a part, where the neighbour isn't known, rows
    stay as well: a group of one set meets nothing.
    """

    def run(batches):
        last = None
        for batch in batches:
            key, sid = (c.to_numpy() for c in batch.columns)
            if last is not None:
                key, sid = np.concatenate([last[0], key]), np.concatenate([last[1], sid])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            key, sid = key[new], sid[new]
            same = key[1:] == key[:-1]
            before, after = np.concatenate([[last is None], same]), np.concatenate([same, [False]])
            if last is not None:
                before[0] = last[2]
            # The last row waits for what follows it.
            keep = (before | after)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(sid[:-1][keep])], ["key", "sid"])
            last = key[-1:], sid[-1:], bool(before[-1])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], ["key", "sid"])

    filled = lambda batches: run(b for b in batches if b.num_rows)
    return keyed.repartitionByRange("key", "sid").sortWithinPartitions("key", "sid").mapInArrow(filled, "key bigint, sid bigint")


def _placed(met: DataFrame, scores: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The groups' members with their scores and components, of groups that hold several."""
    if labels is None:
        return met.join(scores, "sid").withColumn("component", F.col("sid"))
    known = scores.join(labels.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = met.join(known, "sid")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    return placed.join(mixed, "key", "left_semi")


def _star(placed: DataFrame) -> DataFrame:
    """For each node b one pair (a, b): a is the most central leader of its groups in another component.

    A node is the more central the more groups it shares: the original of a cluster shares
    all of its own, an edited copy lacks those that its edits touch.
    """
    leads = placed.groupBy("key").agg(F.max(F.struct("score", "sid", "component")).alias("lead"))
    met = placed.join(leads, "key").where("lead.component <> component")
    best = met.groupBy("sid").agg(F.max("lead").alias("lead"))
    return best.select(F.col("lead.sid").alias("a"), F.col("sid").alias("b"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    return grouped(docs, size).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, mark, n_shingles, component (null without words) and component_id of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    signed = stage(signatures(docs, size), "jaccard-signed")
    filled = signed.where("n_shingles > 0")
    nodes = stage(filled.groupBy("sid").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("rep"), F.min("point").alias("point")), "jaccard-nodes")
    keyed = filled.select(F.explode("keys").alias("key"), "sid")
    met = stage(shared_keys(keyed), "jaccard-met")
    scores = stage(met.groupBy("sid").agg(F.count("*").alias("score")), "jaccard-scores")
    # Of the signatures only these columns are read again.
    rows = stage(signed.select("doc_id", "mark", "n_shingles", "sid"), "jaccard-rows")
    discard(signed)
    sets = stage(whole_sets(docs, nodes.join(scores, "sid").select("sid", "rep"), size), "jaccard-sets")

    # Stars bring most clusters together, at one pair a node and round.
    labels, links, tried = None, None, None
    for _ in range(STAR_ROUNDS):
        star = _bounded(_star(_placed(met, scores, labels)), nodes)
        star = stage(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        tried = star if tried is None else tried.union(star)
        new = verified(sets, star)
        links = stage(new if links is None else links.union(new), "jaccard-links")
        labels = connected(links, "jaccard-labels")

    # Groups that still hold several components, each set of members once.
    placed = stage(_placed(met, scores, labels), "jaccard-mixed")
    discard(met)
    mixed = placed.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("mark"))
    mixed = mixed.groupBy("members", "mark").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("parts"))
    inside = placed.join(mixed, "key").join(nodes.select("sid", "point"), "sid").join(sets.select("sid", "fine"), "sid")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = inside.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "component", "point", "fine")
    pairs = inside.groupBy("key", "i", "j").applyInPandas(_search_block, "a bigint, b bigint").distinct()
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stage(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    if more.limit(1).count():
        links = stage(links.union(verified(sets, more)), "jaccard-links")
        labels = connected(links, "jaccard-labels")

    of = nodes.join(labels.select(F.col("node").alias("sid"), "component"), "sid", "left").select("sid", "rep", F.coalesce("component", "sid").alias("component"))
    least = of.groupBy("component").agg(F.min("rep").alias("least"))
    ids = of.join(least, "component").select("sid", "component", "least")
    out = rows.join(ids, "sid", "left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the row with its smallest id.

    Rows without words stay; of repeated rows that stand for a group one stays. The texts
    move once, to meet the ids that are kept.
    """
    rows = stage(grouped(docs, size), "jaccard-grouped")
    worded = rows.where("component is not null")
    same = worded.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("same"))
    chosen = same.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "same")).alias("one"))
    blank = rows.where("component is null").select("doc_id", "mark", F.lit(1).cast("bigint").alias("same")).distinct()
    keep = stage(chosen.select("one.doc_id", "one.mark", "one.same").union(blank), "jaccard-keep")

    def kept(ids: DataFrame) -> DataFrame:
        here = docs["doc_id"].cast("bigint").eqNullSafe(ids["doc_id"]) & (F.xxhash64(docs["text"]) == ids["mark"])
        return docs.join(ids, here, "left_semi")

    repeated = keep.where("same > 1")
    once = kept(keep.where("same = 1"))
    return once.union(kept(repeated).dropDuplicates(["doc_id", "text"])) if repeated.limit(1).count() else once
