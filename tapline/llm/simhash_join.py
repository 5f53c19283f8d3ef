"""SimHash near duplicates by the generalised pigeonhole principle.

Two texts link when their 64-bit fingerprints differ in at most ``DISTANCE`` bits; classes are
the components of the links.

1. A fingerprint's bit is set where more than half of the XXH64 hashes of the text's shingles
   have it set. Equal fingerprints are one node, however many documents share them.
2. Bits that are correlated over all fingerprints are put into the same partition, so that
   partitions differ in how selective they are (one 64 x 64 table of counts, added up in the
   tasks). The number of partitions follows from the number of fingerprints.
3. If thresholds t_i (-1: not probed) satisfy sum(t_i + 1) = DISTANCE + 1, fingerprints within
   DISTANCE agree within t_i bits on some partition i. For each fingerprint a dynamic program
   chooses the thresholds with the least cost: probes made and candidates expected, the latter
   from counts of the values of up to ``GROUP_BITS`` bits of a partition, taken as independent.
4. Probes meet the partitions' values and candidates are verified on all 64 bits. A fingerprint
   one of whose probes would meet more than ``CROWDED`` values takes the allocation of one
   partition of all bits instead, probed from both sides at half the distance: crowded
   fingerprints within two bits have a value in common that is one bit or less from each. At
   most 65 fingerprints are near such a value, so no group is large, and none is left out:
   pairs with a side that isn't crowded are met by that side's probes.

Cases: texts without words (null, empty, blank) have the fingerprint zero and link like any
other; repeated rows and null ids keep their rows (``component_id`` is the smallest id that
isn't null, null where there is none); an empty table gives no rows; other columns are ignored,
whatever their names. Long texts are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapline.llm.common import arrow_map, connected, joined_by_key, stage

SHINGLE = 3
DISTANCE = 2
BITS = 64
#: Seed of the shingles' hash.
SEED = 42
#: Bits whose values are counted together to estimate candidates.
GROUP_BITS = 11
#: Cost of a candidate in probes.
CANDIDATE_COST = 0.25
#: Values of a partition that one probe may meet; beyond it the fingerprint counts as crowded.
CROWDED = 64
#: Shingles hashed before their bits are added up.
PIECE = 1 << 16
_U = np.uint64


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    width = min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a bigint) of every row."""

    def run(batch):
        prints = [fingerprint((t or "").encode(), size) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fingerprint"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id bigint, fingerprint bigint", run)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_numpy().view(np.uint64)


def bit_pairs(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits set: a 64 x 64 table, added up in the tasks."""

    def count(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for values in _prints(batches):
            bits = _bits(values).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["cell", "n"])

    table = np.zeros(BITS * BITS, np.int64)
    for row in nodes.select("fingerprint").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row.cell] = row.n
    return table.reshape(BITS, BITS)


def parts_for(n: int) -> int:
    """The number of partitions with the least cost a fingerprint, for bits that are set at random."""

    def cost(m: int) -> float:
        width = BITS // m
        thresholds = [(DISTANCE + 1) // m + (i < (DISTANCE + 1) % m) - 1 for i in range(m)]
        probes = sum(len(_masks(list(range(width)), t)) for t in thresholds)
        return probes * (1 + CANDIDATE_COST * n / 2.0**width)

    return min(range(1, DISTANCE + 2), key=cost)


def _masks(bits: list[int], threshold: int) -> list[int]:
    """Every change of at most ``threshold`` of the bits."""
    out = [0] if threshold >= 0 else []
    if threshold >= 1:
        out += [1 << b for b in bits]
    if threshold >= 2:
        out += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[:i]]
    return out


def partition_bits(pairs: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size: a group takes the bits most correlated with it."""
    share = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    likeness = np.abs(pairs / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        near = likeness[np.ix_(left, left)].sum(axis=1)
        group = [left.pop(int(near.argmax()))]
        while len(group) < size:
            group.append(left.pop(int(likeness[np.ix_(left, group)].sum(axis=1).argmax())))
        out.append(group)
    return out


class Allocation:
    """Thresholds and probes of fingerprints: counts of values, and the dynamic program over them."""

    def __init__(self, parts: list[list[int]]):
        self.parts = parts
        self.groups = [[p[i : i + GROUP_BITS] for i in range(0, len(p), GROUP_BITS)] for p in parts]
        self.masks = [[np.array(_masks(p, t), np.uint64) for t in range(-1, DISTANCE + 1)] for p in parts]
        self.tables: list[list[list[np.ndarray]]] = []

    def values(self, bits: np.ndarray, group: list[int]) -> np.ndarray:
        return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group)))

    def learn(self, nodes: DataFrame, n: int) -> None:
        """Count the values of every group of bits over all fingerprints (at most 2^GROUP_BITS each)."""
        flat = [g for part in self.groups for g in part]

        def count(batches):
            totals = [np.zeros(1 << len(g), np.int64) for g in flat]
            for values in _prints(batches):
                bits = _bits(values)
                for g, total in zip(flat, totals, strict=True):
                    total += np.bincount(self.values(bits, g), minlength=len(total))
            at = np.concatenate([np.full(len(t), i) for i, t in enumerate(totals)])
            place = np.concatenate([np.arange(len(t)) for t in totals])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place), pa.array(np.concatenate(totals))], ["grp", "value", "n"])

        counts = [np.zeros(1 << len(g)) for g in flat]
        for row in nodes.select("fingerprint").mapInArrow(count, "grp bigint, value bigint, n bigint").groupBy("grp", "value").agg(F.sum("n").alias("n")).collect():
            counts[row.grp][row.value] = row.n / max(n, 1)
        self.n, self.tables, k = n, [], 0
        for part in self.groups:
            self.tables.append([])
            for g in part:
                # Shares of the values that are 0, 1, 2 bits away.
                share, size = counts[k], np.arange(1 << len(g))
                near = [share] + [sum((share[size ^ m] for m in _masks(list(range(len(g))), t)[len(_masks(list(range(len(g))), t - 1)) :]), np.zeros(len(share))) for t in range(1, DISTANCE + 1)]
                self.tables[-1].append(near)
                k += 1

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """For each fingerprint the thresholds of the partitions (-1: none) that cost least."""
        bits, m = _bits(values), len(values)
        best = np.full((m, DISTANCE + 2), np.inf)
        best[:, 0] = 0
        choices = []
        for i, part in enumerate(self.groups):
            exactly = np.zeros((m, DISTANCE + 1))
            exactly[:, 0] = 1
            for g, near in zip(part, self.tables[i], strict=True):
                v = self.values(bits, g)
                exactly = np.stack([sum(exactly[:, s - t] * near[t][v] for t in range(s + 1)) for s in range(DISTANCE + 1)], axis=1)
            met = np.cumsum(exactly, axis=1) * self.n
            cost = np.zeros((m, DISTANCE + 2))
            for t in range(DISTANCE + 1):
                cost[:, t + 1] = len(self.masks[i][t + 1]) + CANDIDATE_COST * met[:, t]
            after, chosen = np.full_like(best, np.inf), np.zeros((m, DISTANCE + 2), np.int8)
            for total in range(DISTANCE + 2):
                for own in range(total + 1):
                    better = best[:, total - own] + cost[:, own] < after[:, total]
                    after[better, total] = (best[:, total - own] + cost[:, own])[better]
                    chosen[better, total] = own
            best = after
            choices.append(chosen)
        out, total = np.zeros((m, len(self.parts)), np.int64), np.full(m, DISTANCE + 1)
        for i in range(len(self.parts) - 1, -1, -1):
            own = choices[i][np.arange(m), total]
            out[:, i] = own.astype(np.int64) - 1
            total = total - own
        return out

    def probes(self, nodes: DataFrame) -> DataFrame:
        """fingerprint, part, value: the values of the partitions that a fingerprint looks for."""

        def run(batch):
            own = batch.column(0).to_numpy().view(np.uint64)
            chosen = self.thresholds(own)
            for i, bits in enumerate(self.parts):
                mask = _U(sum(1 << b for b in bits))
                for t in range(DISTANCE + 1):
                    rows = own[chosen[:, i] == t]
                    changes = self.masks[i][t + 1]
                    for at in range(0, len(rows), max(1, (1 << 18) // len(changes))):
                        some = rows[at : at + max(1, (1 << 18) // len(changes))]
                        looked = ((some & mask)[:, None] ^ changes[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(changes)).view(np.int64)), pa.array(np.full(len(looked), i, np.int32)), pa.array(looked.view(np.int64))], ["fingerprint", "part", "value"])

        return arrow_map(nodes.select("fingerprint"), "fingerprint bigint, part int, value bigint", run)

    def index(self, nodes: DataFrame) -> DataFrame:
        """other, part, value: every fingerprint with its value in every partition."""
        masks = [int(np.array(sum(1 << b for b in p), np.uint64).view(np.int64)) for p in self.parts]
        rows = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
        return nodes.select(F.col("fingerprint").alias("other"), F.explode(rows).alias("own")).select("other", "own.part", "own.value")


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _crowd_links(crowded: DataFrame) -> DataFrame:
    """Links (a, b) among crowded fingerprints: those within one bit of a common value, as a star."""

    def run(batch):
        own = batch.column(0).to_numpy().view(np.uint64)
        changes = np.array(_masks(list(range(BITS)), DISTANCE // 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(changes)).view(np.int64)), pa.array((own[:, None] ^ changes[None, :]).ravel().view(np.int64))], ["b", "hub"])

    near = arrow_map(crowded.select("fingerprint"), "b bigint, hub bigint", run)
    star = near.withColumn("a", F.min("b").over(W.partitionBy("hub"))).where("a <> b")
    return star.where(_apart("a", "b") <= DISTANCE).select("a", "b")


def links(nodes: DataFrame, n: int, parts: int | None = None, crowd: int = CROWDED) -> DataFrame:
    """Links (a, b) of fingerprints within DISTANCE bits: of crowded ones enough to connect them, of others all."""
    plan = Allocation(partition_bits(bit_pairs(nodes), n, parts or parts_for(n)))
    plan.learn(nodes, n)
    index, probes = plan.index(nodes), stage(plan.probes(nodes), "simhash-probes")
    full = stage(index.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("part", "value"), "simhash-full")
    crowded = stage(probes.join(full, ["part", "value"], "left_semi").select("fingerprint").distinct(), "simhash-crowded")
    open_probes = probes.join(full, ["part", "value"], "left_anti").join(crowded, "fingerprint", "left_anti")
    met = open_probes.join(index.join(full, ["part", "value"], "left_anti"), ["part", "value"]).where((F.col("fingerprint") != F.col("other")) & (_apart("fingerprint", "other") <= DISTANCE))
    pairs = met.select(F.least("fingerprint", "other").alias("a"), F.greatest("fingerprint", "other").alias("b"))
    return pairs.union(_crowd_links(crowded)).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, parts: int | None = None, crowd: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``."""
    rows = stage(fingerprints(docs, size), "simhash-rows")
    nodes = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    n = nodes.count()
    labels = connected(stage(links(nodes, n, parts, crowd), "simhash-links"), "simhash-labels")
    placed = nodes.join(labels.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stage(joined_by_key(placed, least, "component", placed.groupBy("component").agg(F.count("*").alias("n"))).select("fingerprint", "n", "component_id"), "simhash-classes")
    out = joined_by_key(rows, of.drop("n"), "fingerprint", of.select("fingerprint", "n"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
