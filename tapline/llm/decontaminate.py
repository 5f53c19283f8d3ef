"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items feed one suffix automaton (in blocks of bounded size); the words of
each document stream through it, and at every word the automaton tells the longest run of
words ending there that some item contains. Runs of ``window`` words or more are hit, and
so are whole occurrences of items shorter than a window.

Cases: null or empty texts and items have no words and are never hit; items without words
are no windows; repeated rows each get their row; an empty benchmark hits nothing; columns
beyond (doc_id, text) and (item_id, text) are ignored. An item without id hits like any other
and goes by the empty name; items of one id are one item.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.llm.common import arrow_map, stage

WINDOW = 10
#: Item words in one automaton (some 1 KB a word); a larger benchmark is matched in several blocks.
BLOCK_WORDS = 200_000
#: A document with more than this share of its words hit goes; else only its hit spans go.
MOST_COVERED = 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_RUNS = "array<struct<start:int,stop:int>>"


def lowered(text: str) -> str:
    return text.encode().translate(_LOWER).decode()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lowered(text)) if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with what each match means.

    ``steps[state]`` maps a word to the next state, ``link`` and ``size`` are the suffix
    links and longest lengths, ``window_of[state]`` is the ancestor holding the state's last
    ``window`` words, ``short_of[state]`` the nearest state on the link path that is a whole
    short item.
    """

    def __init__(self, items: list[tuple[object, list[str]]], window: int = WINDOW):
        self.window = window
        self.steps: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[tuple[int, int]] = []
        short: dict[int, set[int]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, words) in enumerate(items):
            state = 0
            for w in words:
                state = self._extend(state, w)
                ends.append((state, k))
            if 0 < len(words) < window:
                short.setdefault(state, set()).add(k)
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        self.window_of, self.short_of = [-1] * len(self.size), [-1] * len(self.size)
        for s in order[1:]:
            up = self.link[s]
            if self.size[s] >= window:
                self.window_of[s] = s if self.size[up] < window else self.window_of[up]
            self.short_of[s] = s if s in short else self.short_of[up]
        self.short = {s: (self.size[s], frozenset(k)) for s, k in short.items()}
        # Items with the window of a state: every item that ends a prefix in a state below it.
        found: dict[int, set[int]] = {}
        for s, k in ends:
            if self.window_of[s] >= 0:
                found.setdefault(self.window_of[s], set()).add(k)
        self.items_of = {s: frozenset(k) for s, k in found.items()}

    def _state(self, size: int, like: int = -1) -> int:
        self.steps.append(dict(self.steps[like]) if like >= 0 else {})
        self.link.append(self.link[like] if like >= 0 else -1)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        copy = self._state(self.size[p] + 1, q)
        self.link[q] = copy
        while p >= 0 and self.steps[p].get(w) == q:
            self.steps[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: str) -> int:
        q = self.steps[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        state, p = self._state(self.size[last] + 1), last
        while p >= 0 and w not in self.steps[p]:
            self.steps[p][w] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
            return state
        q = self.steps[p][w]
        self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return state

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word runs [begin, end) in order, merged where they overlap or touch, and the item numbers."""
        steps, link, size, window = self.steps, self.link, self.size, self.window
        window_of, short_of, short = self.window_of, self.short_of, self.short
        root = steps[0]
        runs: list[list[int]] = []
        items: set[int] = set()
        state = length = 0
        for at, w in enumerate(words, 1):
            if state == 0 and w not in root:
                continue
            while state and w not in steps[state]:
                state = link[state]
                length = size[state]
            state = steps[state].get(w, 0)
            length = length + 1 if state else 0
            begin = at
            if length >= window:
                begin = at - length
                items |= self.items_of[window_of[state]]
            s = short_of[state]
            while s > 0:
                n, whole = short[s]
                if n <= length:
                    begin = min(begin, at - n)
                    items |= whole
                s = short_of[link[s]]
            if begin < at:
                while runs and runs[-1][0] >= begin:
                    runs.pop()
                if runs and runs[-1][1] >= begin:
                    runs[-1][1] = at
                else:
                    runs.append([begin, at])
        return [(a, b) for a, b in runs], items


def item_pieces(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item, words) of the items: long ones in pieces of at most ``block_words`` words that
    overlap by a window less one word, so every window lies in a piece."""

    def run(batch):
        size = max(block_words, window)
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            for at in range(0, max(len(words) - window + 1, 1) if words else 0, size - window + 1):
                yield pa.RecordBatch.from_arrays([pa.array([item or ""]), pa.array([words[at : at + size]], pa.list_(pa.string()))], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    return arrow_map(rows, "item string, words array<string>", run)


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[str]]]]:
    """Pieces of items in blocks of at most ``block_words`` words (one piece at least); the driver
    holds one block at a time, as it is broadcast."""
    rows, total = [], 0
    for item, words in item_pieces(benchmark, window, block_words).toLocalIterator():
        if rows and total + len(words) > block_words:
            yield rows
            rows, total = [], 0
        rows.append((item, words))
        total += len(words)
    if rows:
        yield rows


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, items: list[tuple[str, list[str]]], window: int) -> Automaton:
    """A block's automaton, built once in a worker process; a worker holds one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(items, window)
    return _BUILT[name]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Hits of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Each block of items is broadcast (``block_words`` bounds it) and adds its runs and items;
    between blocks the rows are staged, so a task holds one automaton. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.expr(f"cast(null as {_RUNS})").alias("runs"), F.expr("cast(null as array<string>)").alias("items"), F.expr("cast(null as bigint)").alias("n_words"))
    first = True
    for items in item_blocks(benchmark, window, block_words):
        rows = _matched(rows if first else stage(rows, "decontaminate"), items, window)
        first = False
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    def digest(batch):
        out = []
        for text, runs, items, n_words in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
            joined = ",".join(items or [])
            hit = sum(r["stop"] - r["start"] for r in runs or [])
            out.append((len(words_of(text)) if n_words is None else n_words, hit, len(items or []), hashlib.sha256(joined.encode()).hexdigest(), hit > 0))
        cols = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return arrow_map(rows, schema, digest)


def _matched(rows: DataFrame, items: list[tuple[object, list[str]]], window: int) -> DataFrame:
    known, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    runs_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        automaton = _automaton(name, known.value, window)
        names = automaton.ids
        for batch in batches:
            runs, hits, counts = [], [], []
            for text, before, ids in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = words_of(text)
                spans, found = automaton.scan(words)
                counts.append(len(words))
                if before:
                    spans = merged([*spans, *((r["start"], r["stop"]) for r in before)])
                runs.append([{"start": a, "stop": b} for a, b in spans])
                hits.append(sorted({names[k] for k in found} | set(ids or [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, runs_type), pa.array(hits, pa.list_(pa.string())), pa.array(counts, pa.int64())], ["doc_id", "text", "runs", "items", "n_words"])

    return rows.mapInArrow(run, f"doc_id bigint, text string, runs {_RUNS}, items array<string>, n_words bigint")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_runs(text: str, runs: list[tuple[int, int]], most_covered: float = 1.0) -> str | None:
    """``text`` without the words of ``runs``, a line end for each; None where they cover more than ``most_covered``."""
    spans = [m.span() for m in _WORD.finditer(lowered(text))]
    if sum(b - a for a, b in runs) > most_covered * len(spans):
        return None
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "\n".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of ``text`` and documents
    of which more than ``most_covered`` of the words are hit go.

    The hits of all blocks of items are gathered before a document is judged and cut, and cut
    texts are matched with all blocks again until nothing is hit, so the result is the same for
    blocks of any size. All columns stay; null texts stay null.
    """
    blocks = list(_broadcast(docs, item_blocks(benchmark, window, block_words)))
    if not blocks:
        return docs
    done, todo, most = [], docs, most_covered
    while True:
        rows = todo.select("*", F.expr(f"cast(null as {_RUNS})"), F.lit(False)).toDF(*(f"c{i}" for i in range(len(docs.columns))), "runs", "cut")
        for i, (name, known) in enumerate(blocks):
            last = most if i == len(blocks) - 1 else None
            rows = stage(_with_runs(rows, name, known, docs.columns.index("text"), window, last), "decontaminate")
        plain = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
        done.append(rows.where("not cut").select(*plain))
        todo, most = rows.where("cut").select(*plain), 1.0
        if not todo.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _broadcast(docs: DataFrame, blocks: Iterator[list]) -> Iterator[tuple[str, Broadcast]]:
    for items in blocks:
        yield uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)


def _with_runs(rows: DataFrame, name: str, known: Broadcast, place: int, window: int, most_covered: float | None) -> DataFrame:
    """``rows`` with the hit runs of a block of items added to those in the column before the last.

    With ``most_covered``, for the last block, texts lose their runs, the last column tells where
    something was cut, and documents covered beyond it go.
    """

    def run(batches):
        automaton = _automaton(name, known.value, window)
        for batch in batches:
            at = batch.num_columns - 2
            texts, runs = batch.column(place).to_pylist(), []
            for text, before in zip(texts, batch.column(at).to_pylist(), strict=True):
                spans, _ = automaton.scan(words_of(text))
                runs.append(merged([*spans, *((r["start"], r["stop"]) for r in before or [])]) if before else spans)
            columns = list(batch.columns)
            keep = None
            if most_covered is None:
                columns[at] = pa.array([[{"start": a, "stop": b} for a, b in own] for own in runs], batch.schema.field(at).type)
            else:
                new = [without_runs(t, own, most_covered) if own else t for t, own in zip(texts, runs, strict=True)]
                columns[place] = pa.array(new, batch.schema.field(place).type)
                columns[-1] = pa.array([bool(own) for own in runs])
                keep = pa.array([t is None or n is not None for t, n in zip(texts, new, strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield out if keep is None else out.filter(keep)

    return rows.mapInArrow(run, rows.schema)
