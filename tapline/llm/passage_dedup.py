"""Near-duplicate passages by compact windows.

Tokens are five-word shingles. The Cartesian tree of a document's token hashes gives the
compact windows: the widest ranges in which one token has the smallest hash. All runs of
``sure_run`` tokens inside a window that contain that token meet by it, so a document has
about 2 n / run windows instead of n runs.

1. Two passages with the similarity share a run of ``sure_run`` consecutive tokens (see
   there). A signature is the smallest token of a window together with the half run before
   it, and with the half run after it, as far as the window reaches; every run in a window
   covers one of the two halves, so equal runs have an equal signature under any hash.
2. In each meeting every document is paired with the shortest (pairs grow with the rows, not
   with their square). Signatures that a sample finds hot are dealt over salts, whose
   leaders meet once more.
3. Equal tokens around each meeting place of a pair are aligned, and the longest range that
   holds the similarity is kept if both passages are long enough and their shingle sets have
   a Jaccard similarity of 0.8. A range that fails is narrowed, not dropped.
4. Documents of one signature that are in different classes after that meet each other too,
   where enough of the tokens around the signature stand in another class as well
   (``dense_places``); what is left out there can hold no passage with the similarity. In
   ``ROUNDS`` rounds one more leader meets the others, then all that are left meet.

Documents with equal words are one node: their copies are members of its class, not pairs.

Cases: null, empty and short texts have no passages; repeated rows and null ids keep their
rows; a document is never paired with itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.llm.common import arrow_map, blocks, connected, lower_ascii, mix, only_listed, shingle_hashes, span_hashes, stage, text_column, word_spans

SHINGLE = 5
#: Least words of a passage, and least similarity of the shingle sets of two.
LEAST, SIMILAR = 50, 0.8
#: Hash functions that windows are made by. Every sure run meets by one; more repeat its meetings.
HASHES = 1
#: Rounds of further leaders before the documents left of a signature meet pair by pair.
ROUNDS = 3
#: Rows of the sample that hot signatures are found in, their least count in it, and the parts each is dealt into.
SAMPLE_ROWS, HOT_ROWS, SALTS = 200_000, 100, 64

_U = np.uint64


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, row) of joined rows."""
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, bounds)
    return span_hashes(data, starts, ends), rows


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, row) of joined rows, then (word hash, row) of their words."""
    words, rows = words_of(data, bounds)
    return *shingle_hashes(words, rows, SHINGLE), words, rows


def _reach(hashes: np.ndarray, rows: np.ndarray, step: int, limit: int) -> np.ndarray:
    """How far (up to ``limit``) each token stays the smallest in direction ``step`` in its row.

    Of equal tokens the first counts as the smaller one. Only tokens that are still smallest
    are looked at again, so the work is about n log(limit).
    """
    n = len(hashes)
    far = np.zeros(n, np.int64)
    live = np.arange(n)
    for distance in range(1, limit + 1):
        to = live + step * distance
        inside = (to >= 0) & (to < n)
        live, to = live[inside], to[inside]
        smaller = hashes[to] > hashes[live] if step < 0 else hashes[to] >= hashes[live]
        live = live[(rows[to] == rows[live]) & smaller]
        far[live] = distance
    return far


def compact_windows(tokens: np.ndarray, rows: np.ndarray, seed: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the smallest tokens of the compact windows of ``least`` tokens or more, and
    how far each window reaches to both sides (``least`` at most)."""
    hashes = mix(tokens ^ _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    left, right = _reach(hashes, rows, -1, least), _reach(hashes, rows, 1, least)
    wide = np.flatnonzero(left + right + 1 >= least)
    return wide, left[wide], right[wide]


def sure_run(least: int, similar: float) -> int:
    """Consecutive tokens that two passages of ``least`` tokens or more with the similarity have in common.

    They share ``similar * least`` tokens at least. Where the shared ones stand in several
    pieces, the words at each break make ``SHINGLE - 1`` tokens of either passage that the other
    lacks, and the similarity bounds such tokens by (1 - similar) / similar of the shared ones.
    The longest piece is no shorter than the mean. (Words that repeat at the breaks of several
    moved pieces can make the breaks cheaper.)
    """
    lost = 2 * (SHINGLE - 1) * similar / max(1 - similar, 1e-9)
    return max(3, min(math.ceil(max(similar * least, lost * (pieces - 1)) / pieces - 1e-6) for pieces in range(1, 9)))


def signatures(tokens: np.ndarray, rows: np.ndarray, least: int, hashes: int, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, place) of the windows' meetings, by row, signature and place.

    Of places of a signature whose half runs overlap (the text repeats itself there) the first
    is given: a passage that holds a later one gains no token by reaching back to it.
    """
    run = sure_run(least, similar)
    half = (run - 1) // 2
    keys, at = [], []
    for seed in range(1, hashes + 1):
        place, left, right = compact_windows(tokens, rows, seed, run)
        for side, reach, step in ((1, left, -1), (2, right, 1)):
            own = place[reach >= half]
            key = mix(tokens[own] + _U(16 * seed + side))
            for distance in range(1, half + 1):
                key = mix(key + tokens[own + step * distance])
            keys.append(key)
            at.append(own)
    key, place = np.concatenate(keys), np.concatenate(at)
    order = np.lexsort((place, key, rows[place]))
    key, place = key[order], place[order]
    kept = np.ones(len(key), bool)
    kept[1:] = (key[1:] != key[:-1]) | (rows[place[1:]] != rows[place[:-1]]) | (place[1:] - place[:-1] > half)
    return key[kept], rows[place[kept]], place[kept]


def told_apart(tokens: np.ndarray, rows: np.ndarray, key: np.ndarray, row: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
    """Which of the places, sorted by row and signature, stay if one stands for all of a signature
    in a row that have the same ``reach`` tokens on both sides.

    A text that repeats a line a thousand times has a few such places and not a thousand.
    """
    kept = np.ones(len(key), bool)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    begin, end = np.searchsorted(rows, row[again], "left"), np.searchsorted(rows, row[again], "right")
    seen: set[tuple[int, bytes]] = set()
    for k, low, high in zip(np.flatnonzero(again).tolist(), begin.tolist(), end.tolist(), strict=True):
        if not again[k - 1]:
            seen = {_around(tokens, int(place[k - 1]), reach, low, high)}
        around = _around(tokens, int(place[k]), reach, low, high)
        kept[k] = around not in seen
        seen.add(around)
    return kept


def _around(tokens: np.ndarray, at: int, reach: int, low: int, high: int) -> tuple[int, bytes]:
    begin = max(low, at - reach)
    return at - begin, hashlib.blake2b(tokens[begin : min(high, at + reach + 1)].tobytes(), digest_size=16).digest()


def _word_ids(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    cut = np.concatenate([[0], np.cumsum(counts)])
    return np.array([int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)


def _token_rows(docs: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make`` builds from the tokens of a block of documents."""

    def run(batch):
        data, bounds = text_column(batch.column(1))
        for i, j in blocks(bounds):
            tokens, rows, words, word_rows = tokens_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            counts = np.bincount(word_rows, minlength=j - i)
            yield make(batch.column(0).slice(i, j - i), tokens, rows, _word_ids(words, counts), counts)

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), schema, run)


def node_rows(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of its words), words."""
    return _token_rows(docs, "doc_id bigint, node bigint, words bigint", lambda ids, tokens, rows, nodes, counts: pa.RecordBatch.from_arrays([ids, pa.array(nodes), pa.array(counts)], ["doc_id", "node", "words"]))


def window_rows(docs: DataFrame, least: int, hashes: int, similar: float) -> DataFrame:
    """signature, words, node of all windows; each signature once a row."""

    def make(ids, tokens, rows, nodes, counts):
        key, row, _ = signatures(tokens, rows, least, hashes, similar)
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[first], row[first]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(counts[row].astype(np.int32)), pa.array(nodes[row])], ["signature", "words", "node"])

    return _token_rows(docs, "signature bigint, words int, node bigint", make)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each window with its signature's leader, from rows sorted by (salted, words, node).

    The leader's own row comes out as a pair with itself where its signature is salted.
    """
    key = lead = None
    for batch in batches:
        salted, signature, salt, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(salted):
            continue
        new = np.ones(len(salted), bool)
        new[1:] = (signature[1:] != signature[:-1]) | (salt[1:] != salt[:-1])
        new[0] = key != (signature[0], salt[0])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        leads = np.where(begin < 0, lead if lead is not None else 0, node[np.maximum(begin, 0)])
        keep = (leads != node) | (new & salted)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (signature, salted, leads, node)], ["signature", "salted", "a", "b"])
        key, lead = (signature[-1], salt[-1]), leads[-1]


def meetings(windows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): two nodes with a signature in common, a the shorter document; and (signature, node) of those that meet."""
    schema = "signature bigint, salted boolean, a bigint, b bigint"
    dealt = windows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "signature", "left")
    dealt = dealt.select(F.coalesce("hot", F.lit(False)).alias("salted"), "signature", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), "words", "node")
    dealt = dealt.repartition("signature", "salt").sortWithinPartitions("signature", "salt", "words", "node").select("salted", "signature", "salt", "node")
    pairs = stage(dealt.mapInArrow(_stars, schema), "passages-meetings")
    # The leaders of a hot signature's parts: SALTS rows at most for each.
    leaders = pairs.where("salted and a = b").select("signature", "a")
    top = leaders.groupBy("signature").agg(F.min("a").alias("top"))
    across = leaders.join(top, "signature").where("a <> top").select(F.col("top").alias("a"), F.col("a").alias("b"))
    members = pairs.select("signature", F.col("a").alias("node")).union(pairs.select("signature", "b")).distinct()
    return pairs.where("a <> b").select("a", "b").union(across).distinct(), members


def dense_places(members: DataFrame, known: DataFrame, texts: DataFrame, least: int, similar: float) -> DataFrame:
    """(signature, node, words, width, gains): nodes of signatures of several components, where a passage may hold it.

    A passage with the similarity has (1 - similar) of its distinct tokens at most that the
    other document lacks. So a place of a signature is left out if no range of ``least`` tokens
    around it (``width`` is the widest) has so few that stand in no other component of the
    documents in question. ``gains`` are the greatest of ``_Gains`` at the node's places.
    """
    placed = members.join(known, "node")
    split = placed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("signature")
    open_nodes = stage(placed.join(split, "signature", "left_semi").select("node", "component").distinct(), "passages-open")
    own = texts.join(open_nodes, "node")
    tokens = own.select("node", "component", F.explode(F.array_distinct("tokens")).alias("token"))
    common = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    marks = tokens.join(common, "token", "left_semi").groupBy("node").agg(F.collect_list("token").alias("common"))

    def run(batch):
        nodes, words, tokens, keys, places, common = batch.columns
        for k in range(batch.num_rows):
            token, key, place = (c[k].values.to_numpy() for c in (tokens, keys, places))
            codes, listed, size = _coded(token, common[k].values.to_numpy())
            shared = _marked(listed, size)
            begin, end = _Hulls(codes, shared, similar).around(place)
            wide = np.flatnonzero(end - begin >= least)
            around = _Gains(codes, shared, similar, least)
            each = [around.around(*x) for x in zip(place[wide].tolist(), begin[wide].tolist(), end[wide].tolist(), strict=True)]
            key, at = np.unique(key[wide], return_inverse=True)
            width, gains = np.zeros(len(key), np.int64), np.full((len(key), 3), -(1 << 60))
            np.maximum.at(width, at, (end - begin)[wide])
            np.maximum.at(gains, at, np.array(each, np.int64).reshape(-1, 3))
            columns = [pa.array(key), *(pa.array(np.full(len(key), c[k].as_py(), np.int64)) for c in (nodes, words)), pa.array(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * 3), pa.array(gains.ravel()))], ["signature", "node", "words", "width", "gains"])

    return arrow_map(own.join(marks, "node").select("node", "words", "tokens", "keys", "places", "common"), "signature bigint, node bigint, words bigint, width bigint, gains array<bigint>", run)


def rest_pairs(dense: DataFrame, known: DataFrame, leaders: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b): nodes of different components with a signature in common, with ``leaders`` those of
    each signature's widest place only; and the places that are left without the leaders'.

    Without ``leaders`` a pair is left out if the gains say that no passage of the two can hold
    the signature; one that holds another signature of theirs meets by that.
    """
    me = F.struct("width", "node", "words", "component", "gains")
    placed = dense.join(known, "node").select("signature", me.alias("one"))
    split = placed.groupBy("signature").agg(F.min("one.component").alias("low"), F.max("one.component").alias("high"), F.max("one").alias("other")).where("low <> high")
    if leaders:
        met = placed.join(split, "signature").where("one.node <> other.node")
        left = met.select("signature", "one.node", "one.words", "one.width", "one.gains")
    else:
        # Places that can't meet the greatest gains of their signature meet none.
        most = placed.groupBy("signature").agg(F.array(*(F.max(F.col("one.gains")[k]) for k in range(3))).alias("most"), F.min("one.component").alias("low"), F.max("one.component").alias("high"))
        met = placed.join(most.where("low <> high").select("signature", "most"), "signature").where(_can_meet(F.col("one.gains"), F.col("most"))).drop("most")
        met = met.join(met.select("signature", F.col("one").alias("other")), "signature").where("one.node < other.node")
        met = met.where(_can_meet(F.col("one.gains"), F.col("other.gains")))
        left = dense.limit(0)
    shorter = F.struct("one.words", "one.node") < F.struct("other.words", "other.node")
    pair = F.when(shorter, F.struct(F.col("one.node").alias("a"), F.col("other.node").alias("b"))).otherwise(F.struct(F.col("other.node").alias("a"), F.col("one.node").alias("b")))
    return met.where("one.component <> other.component").select(pair.alias("pair")).select("pair.*").distinct(), left


def joined_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, component) with the components that ``links`` connect made one."""
    ends = links.select("a", "b").distinct()
    for side in "ab":
        ends = ends.join(known.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side)
    merged = connected(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b"), "passages-merged")
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("low"))
    return stage(known.join(merged, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "passages-components")


def _grown(own: np.ndarray, shared: np.ndarray, at: int, loss: float) -> tuple[int, int]:
    """The range around ``at`` that gains most, a shared token counting 1 and another -``loss``."""
    gain = np.where(shared, 1.0, -loss)
    right = np.cumsum(gain[at:])
    left = np.cumsum(gain[: at + 1][::-1])
    return at - int(left.argmax()), at + int(right.argmax()) + 1


class _Hulls:
    """For each place, the union of the ranges around it whose distinct tokens may be shared to ``similar``.

    ``codes`` are the tokens of a text, ``shared`` says of each code whether it is shared. Of an
    unshared token only the first place counts, so no range that meets ``similar`` lies outside.
    """

    def __init__(self, codes: np.ndarray, shared: np.ndarray, similar: float):
        whole = round(similar * 1_000_000)
        first = np.zeros(len(shared), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        own = shared[codes]
        loss = np.where(first[codes] == np.arange(len(codes)), -whole, 0)
        total = np.concatenate([[0], np.cumsum(np.where(own, 1_000_000 - whole, loss))])
        self.low = np.minimum.accumulate(total)
        self.high = np.maximum.accumulate(total[::-1])[::-1]

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.searchsorted(-self.low, -self.high[at + 1], "left")
        end = np.searchsorted(-self.high, -self.low[at], "right") - 1
        inside = (begin <= at) & (at < end)
        return np.where(inside, begin, at), np.where(inside, end, at)


class _Gains:
    """For each place, how far the distinct tokens of a range around it can reach ``similar``.

    Two ranges with the similarity have (1 - similar) * shared - similar * (own of one + own of
    the other) >= 0, over distinct tokens. ``around`` gives the greatest value that one range of
    ``least`` tokens or more can add to that if it is credited with all, half or none of the
    shared tokens: ranges around two places can have the similarity only where the credits that
    make up a whole add up to 0 or more (``_can_meet``). Shared tokens count on each side of the
    place once, tokens that the other text lacks once in all, so the values are never too small.
    """

    def __init__(self, codes: np.ndarray, shared: np.ndarray, similar: float, least: int):
        order = np.argsort(codes, kind="stable")
        same = codes[order[1:]] == codes[order[:-1]]
        self.before, self.after = np.full(len(codes), -1), np.full(len(codes), len(codes))
        self.before[order[1:][same]], self.after[order[:-1][same]] = order[:-1][same], order[1:][same]
        self.own, self.least, self.seen = shared[codes], least, {}
        self.loss = int(similar * 1_000_000 + 1e-6)

    def around(self, at: int, begin: int, end: int) -> tuple[int, int, int]:
        """Of ranges in [begin, end), the hull of the place."""
        if at not in self.seen:
            self.seen[at] = self._best(at, begin, end)
        return self.seen[at]

    def _best(self, at: int, begin: int, end: int) -> tuple[int, int, int]:
        if end - begin < self.least:
            return (-(1 << 60),) * 3
        left, right = self.after[begin:at], self.before[at:end] < at
        own = self.own[begin:end]
        gain = own & np.concatenate([left >= at, right])
        lost = ~own & np.concatenate([left >= end, right])
        totals = np.zeros((3, end - begin + 1), np.int64)
        np.cumsum(np.array([[2], [1], [0]]) * (1_000_000 - self.loss) * gain - 2 * self.loss * lost, axis=1, out=totals[:, 1:])
        first = np.arange(min(at - begin, end - begin - self.least) + 1)
        best = np.maximum.accumulate(totals[:, ::-1], axis=1)[:, ::-1][:, np.maximum(first + self.least, at - begin + 1)]
        return tuple((best - totals[:, first]).max(axis=1).tolist())


def _can_meet(one, other):
    """Whether ranges with these gains (all, half, none) can have the similarity; of numbers or of columns."""
    return (one[0] + other[2] >= 0) & (one[1] + other[1] >= 0) & (one[2] + other[0] >= 0)


def _rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising part of ``values``."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        spot = bisect_left(tops, v)
        before[k] = ends[spot - 1] if spot else -1
        if spot == len(tops):
            tops.append(v)
            ends.append(k)
        else:
            tops[spot], ends[spot] = v, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The tokens of both as small numbers, in the same order, and how many numbers there are."""
    kinds, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    return codes[: len(a)], codes[len(a) :], len(kinds)


def _marked(codes: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` codes, whether it stands in ``codes``."""
    out = np.zeros(size, bool)
    out[codes] = True
    return out


def _aligned(a: np.ndarray, b: np.ndarray, in_b: np.ndarray, at_a: int, at_b: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of equal codes that rise in both, through (at_a, at_b), and the index of that pair.

    ``in_b`` tells which of ``a`` stand in ``b``; of several equal codes in ``b`` the one
    nearest to the diagonal of the pair is taken.
    """
    n = len(b) + 1
    spots = np.sort(b * n + np.arange(n - 1))
    i = np.flatnonzero(in_b)
    want = np.clip(i + at_b - at_a, 0, n - 2)
    asked = a[i] * n + want
    k = np.searchsorted(spots, asked)
    after, prior = spots[np.minimum(k, n - 2)], spots[np.maximum(k - 1, 0)]
    far_after = np.where(after // n == a[i], np.abs(after - asked), n)
    far_prior = np.where(prior // n == a[i], np.abs(prior - asked), n)
    j = np.where(far_after <= far_prior, after, prior) % n
    sides = []
    for side in ((i < at_a) & (j < at_b), (i > at_a) & (j > at_b)):
        x, y = i[side], j[side]
        if len(y) > 1 and not (y[1:] > y[:-1]).all():
            kept = _rising(y.tolist())
            x, y = x[kept], y[kept]
        sides.append((x, y))
    (lx, ly), (rx, ry) = sides
    return np.concatenate([lx, [at_a], rx]), np.concatenate([ly, [at_b], ry]), len(lx)


def _widest(i: np.ndarray, j: np.ndarray, c: int, similar: float) -> tuple[int, int]:
    """First and last of the aligned pairs, ``c`` among them, of the longest range that meets ``similar`` by places."""
    height = (1 + similar) * np.arange(len(i)) - similar * (i + j)
    high = np.maximum.accumulate(height[c:][::-1])[::-1]
    last = np.searchsorted(-high, -(height[: c + 1] - (1 - similar) - 1e-9), "right") - 1 + c
    length = np.where(last >= c, i[last] + j[last] - i[: c + 1] - j[: c + 1], -1)
    first = int(length.argmax())
    return first, max(int(last[first]), c)


def _densest(i: np.ndarray, j: np.ndarray, c: int, least: int) -> tuple[int, int]:
    """First and last of the most aligned pairs, ``c`` among them, inside ``least`` places of both."""
    first = np.arange(max(0, c - least), c + 1)
    last = np.minimum(np.searchsorted(i, i[first] + least), np.searchsorted(j, j[first] + least)) - 1
    count = np.where(last >= c, last - first, -1)
    k = int(count.argmax())
    return int(first[k]), max(int(last[k]), c)


def _padded(begin: int, end: int, least: int, size: int) -> list[tuple[int, int]]:
    """The range, or the ranges of ``least`` places that reach beyond one or both of its ends."""
    missing = least - (end - begin)
    if missing <= 0:
        return [(begin, end)]
    starts = {min(max(0, begin - before), max(0, size - least)) for before in (0, missing, missing // 2)}
    return [(s, min(size, s + least)) for s in sorted(starts)]


def _passage(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, hulls: tuple[tuple[int, int], tuple[int, int]], least: int, similar: float) -> tuple[int, int, int, int, float] | None:
    """A long range of both texts around a pair of places whose token sets have the similarity, if there is one."""
    (a0, a1), (b0, b1) = hulls
    # A passage of the least length may end in tokens that aren't shared.
    whole = (a0, a1, b0, b1)
    a0, a1, b0, b1 = max(0, a0 - least), min(len(a), a1 + least), max(0, b0 - least), min(len(b), b1 + least)
    own, other, at_a, at_b = a[a0:a1], b[b0:b1], at_a - a0, at_b - b0
    if min(len(own), len(other)) < least:
        return None
    own, other, size = _coded(own, other)

    def judged(x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int, int, float] | None:
        for p0, p1 in _padded(x0, x1, least, len(own)):
            for q0, q1 in _padded(y0, y1, least, len(other)):
                x, y = _marked(own[p0:p1], size), _marked(other[q0:q1], size)
                both = int(np.count_nonzero(x & y))
                likeness = both / (int(np.count_nonzero(x)) + int(np.count_nonzero(y)) - both)
                if likeness >= similar:
                    return a0 + p0, a0 + p1, b0 + q0, b0 + q1, likeness
        return None

    in_other = _marked(other, size)[own]
    i, j, c = _aligned(own, other, in_other, at_a, at_b)
    tried = set()
    # Equal tokens count once in a set but at each of their places: a range that fails is narrowed down to a run.
    for part in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0):
        k, m = _widest(i, j, c, similar + (1 - similar) * part)
        if (k, m) in tried:
            continue
        tried.add((k, m))
        # Ranges much shorter than a passage fail whatever stands beside them.
        if max(i[m] - i[k], j[m] - j[k]) + 1 >= least * similar:
            if found := judged(int(i[k]), int(i[m]) + 1, int(j[k]), int(j[m]) + 1):
                return found
    k, m = _densest(i, j, c, least)
    if (k, m) not in tried and m - k + 1 >= least * similar / 2:
        if found := judged(int(i[k]), int(i[m]) + 1, int(j[k]), int(j[m]) + 1):
            return found
    # Passages with parts in another order.
    for loss in (4.0, 9.0, 19.0):
        x0, x1 = _grown(own, in_other, at_a, loss)
        y0, y1 = _grown(other, _marked(own[x0:x1], size)[other], at_b, loss)
        x0, x1 = _grown(own, _marked(other[y0:y1], size)[own], at_a, loss)
        if min(x1 - x0, y1 - y0) >= least * similar:
            if found := judged(x0, x1, y0, y1):
                return found
    # Texts that repeat the tokens the other lacks: their places weigh nothing in a set.
    return judged(whole[0] - a0, whole[1] - a0, whole[2] - b0, whole[3] - b0)


def passages(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], least: int, similar: float) -> list[tuple[int, int, int, int, float]]:
    """Verified passages (a begin, a end, b begin, b end, similarity) in tokens, from pairs of places.

    Only a passage that is accepted spares the other pairs of places inside it.
    """
    found: list[tuple[int, int, int, int, float]] = []
    a, b, size = _coded(a, b)
    shared = _marked(a, size) & _marked(b, size)
    at_a, at_b = np.array(sorted(set(anchors)), np.int64).reshape(-1, 2).T
    hulls_a, hulls_b = _Hulls(a, shared, similar).around(at_a), _Hulls(b, shared, similar).around(at_b)
    # No passage with the similarity reaches beyond a hull.
    left = np.flatnonzero((hulls_a[1] - hulls_a[0] >= least) & (hulls_b[1] - hulls_b[0] >= least))
    gains = [_Gains(text, shared, similar, least) for text in (a, b)] if len(left) else []
    while len(left):
        k, left = int(left[0]), left[1:]
        own = gains[0].around(int(at_a[k]), int(hulls_a[0][k]), int(hulls_a[1][k]))
        if own[0] < 0 or not _can_meet(own, gains[1].around(int(at_b[k]), int(hulls_b[0][k]), int(hulls_b[1][k]))):
            continue
        one = _passage(a, b, int(at_a[k]), int(at_b[k]), tuple((int(h[0][k]), int(h[1][k])) for h in (hulls_a, hulls_b)), least, similar)
        if one:
            if one not in found:
                found.append(one)
            x0, x1, y0, y1, _ = one
            left = left[(at_a[left] < x0) | (at_a[left] >= x1) | (at_b[left] < y0) | (at_b[left] >= y1)]
    return found


def anchors_of(keys_a: np.ndarray, places_a: np.ndarray, keys_b: np.ndarray, places_b: np.ndarray) -> list[tuple[int, int]]:
    """All pairs of places with the same signature; the keys of a text are sorted."""
    first, last = np.searchsorted(keys_b, keys_a, "left"), np.searchsorted(keys_b, keys_a, "right")
    counts = last - first
    skip = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else counts
    return list(zip(np.repeat(places_a, counts).tolist(), places_b[np.arange(int(counts.sum())) + skip].tolist(), strict=True))


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, least: int, hashes: int, similar: float) -> DataFrame:
    """node, words, tokens, signatures (keys, sorted, and their places) of the wanted nodes, from one copy of each."""
    wanted = stage(nodes.join(wanted, "node").select("node", "words", F.col("rep").alias("doc_id")), "passages-wanted")
    reals = wanted.withColumnRenamed("doc_id", "rep")

    def make(ids, tokens, rows, own, counts):
        def lists(at, values):
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(own) + 1)).astype(np.int32)), pa.array(values))

        key, row, place = signatures(tokens, rows, least, hashes, similar)
        key = key.view(np.int64)
        order = np.lexsort((place, key, row))
        key, row, place = key[order], row[order], place[order]
        kept = told_apart(tokens, rows, key, row, place, 2 * least)
        key, row, place = key[kept], row[kept], place[kept]
        place = place - np.searchsorted(rows, row)
        return pa.RecordBatch.from_arrays([ids, pa.array(own), lists(rows, tokens.astype(np.uint32).view(np.int32)), lists(row, key), lists(row, place.astype(np.int32))], ["doc_id", "node", "tokens", "keys", "places"])

    texts = _token_rows(only_listed(docs.select("doc_id", "text"), "doc_id", wanted), "doc_id bigint, node bigint, tokens array<int>, keys array<bigint>, places array<int>", make)
    texts = texts.join(reals, "node").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", F.struct("words", "tokens", "keys", "places").alias("text"))
    return stage(texts.groupBy("node").agg(F.first("text").alias("text")).select("node", "text.*"), "passages-tokens")


def _verified(pairs: DataFrame, texts: DataFrame, least: int, similar: float) -> DataFrame:
    """(a, b, a_begin, a_end, b_begin, b_end, similarity) of the passages of pairs of nodes, in words."""

    def verify(batch):
        out = []
        columns = batch.columns
        for k in range(batch.num_rows):
            x, y, keys_x, keys_y, places_x, places_y = (c[k].values.to_numpy() for c in columns[2:])
            for x0, x1, y0, y1, likeness in passages(x, y, anchors_of(keys_x, places_x, keys_y, places_y), least, similar):
                out.append((columns[0][k].as_py(), columns[1][k].as_py(), x0, x1 + SHINGLE - 1, y0, y1 + SHINGLE - 1, likeness))
        if out:
            kinds = (*(pa.int64(),) * 6, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "b", "a_begin", "a_end", "b_begin", "b_end", "similarity"])

    sides = [texts.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("tokens", "keys", "places"))) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "tokens_a", "tokens_b", "keys_a", "keys_b", "places_a", "places_b")
    return arrow_map(joined, "a bigint, b bigint, a_begin bigint, a_end bigint, b_begin bigint, b_end bigint, similarity double", verify)


def passage_links(docs: DataFrame, nodes: DataFrame, least_words: int = LEAST, similar: float = SIMILAR, hashes: int = HASHES) -> tuple[DataFrame, DataFrame]:
    """(a, b, a_begin, a_end, b_begin, b_end, similarity) of verified passages of two nodes, in words; and
    (node, component): the smallest node that passages connect with each of these nodes."""
    least = least_words - SHINGLE + 1
    windows = window_rows(docs, least, hashes, similar)
    size = max(1, nodes.agg(F.sum(F.col("words") * F.col("copies"))).first()[0] or 1)
    share = min(1.0, SAMPLE_ROWS * sure_run(least, similar) / (3 * hashes * size))
    sample = window_rows(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1), least, hashes, similar)
    hot = stage(sample.groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS).select("signature"), "passages-hot")
    pairs, members = meetings(windows, hot)
    pairs = stage(pairs, "passages-pairs")
    texts = _texts(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), least, hashes, similar)
    links = stage(_verified(pairs, texts, least, similar), "passages-links")
    known = joined_components(members.select("node", F.col("node").alias("component")).distinct(), links)

    # Nodes that their leaders don't connect are compared with further leaders, and then with each other.
    tried = pairs
    dense = stage(dense_places(members, known, texts, least, similar), "passages-dense")
    for leaders in (True,) * ROUNDS + (False,):
        rest, dense = rest_pairs(dense, known, leaders)
        rest = stage(rest.join(tried, ["a", "b"], "left_anti"), "passages-rest")
        dense = stage(dense, "passages-left")
        more = stage(_verified(rest, texts, least, similar), "passages-more")
        tried, links = tried.union(rest), links.union(more)
        if more.limit(1).count():
            known = joined_components(known, more)
    return links, known


def repeated_passages(docs: DataFrame, least_words: int = LEAST, similar: float = SIMILAR, hashes: int = HASHES) -> DataFrame:
    """doc_id, partner_id, begin, end, partner_begin, partner_end (words), similarity, class_id.

    A row for each verified passage of two documents that stand for their copies, and one for
    each copy with the document that stands for it. ``class_id`` is the smallest id that
    passages and copies connect with the row. Documents without repeated passages have no row.
    """
    docs = docs.select("doc_id", "text")
    rows = stage(node_rows(docs), "passages-nodes")
    nodes = rows.where(F.col("words") >= least_words).groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("words").alias("words"), F.count("*").alias("copies"))
    nodes = stage(nodes, "passages-classes")
    links, labels = passage_links(docs, nodes, least_words, similar, hashes)
    placed = nodes.join(labels, "node", "left").select("node", "rep", "words", "copies", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("class_id"))
    placed = stage(placed.join(least, "component").select("node", "rep", "words", "copies", "class_id"), "passages-placed")
    one = placed.select(F.col("node").alias("a"), F.col("rep").alias("partner_id"), "class_id")
    other = placed.select(F.col("node").alias("b"), F.col("rep").alias("doc_id"))
    pairs = links.join(one, "a").join(other, "b").select("doc_id", "partner_id", F.col("b_begin").alias("begin"), F.col("b_end").alias("end"), F.col("a_begin").alias("partner_begin"), F.col("a_end").alias("partner_end"), "similarity", "class_id")
    copies = rows.join(placed.where("copies > 1").select("node", "rep", "class_id", F.col("words").alias("end")), "node").where(~F.col("doc_id").eqNullSafe(F.col("rep")))
    zero = F.lit(0).cast("bigint")
    return pairs.union(copies.select("doc_id", F.col("rep").alias("partner_id"), zero.alias("begin"), "end", zero.alias("partner_begin"), F.col("end").alias("partner_end"), F.lit(1.0).alias("similarity"), "class_id"))
