"""Datagrams from IP fragments that arrive in any order.

Fragments are shuffled by (file, addresses, number), so one pair of hosts is spread over its
numbers, and each number's fragments are folded in capture order with one datagram in hand.
A pause of ``GAP_S`` between fragments of a number ends what is incomplete, as in a host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Seconds without a fragment after which a number is used for another datagram.
GAP_S = 5.0
#: Bytes of the largest IP datagram; a fragment behind them is none.
MOST_BYTES = 1 << 16
KEY = ["file_idx", "src_ip", "dst_ip", "ident"]
SCHEMA = (
    "file_idx int, src_ip string, dst_ip string, ident bigint, proto bigint, at bigint, more boolean, data binary, "
    "frame_number bigint, ts_epoch double, t_rel double"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Assembly:
    """The fragments of one number: those of the datagram in hand, and those that look like
    doubles of the datagram before it.

    A fragment equal to one of the datagram just completed may be a late double or the first
    sign of the next datagram, so it waits: waiting fragments that make a datagram by themselves
    are the same datagram sent again, and others count when the datagram in hand ends (by a
    pause or by a fragment with other bytes at a place that is held) without being complete.
    """

    def __init__(self) -> None:
        self.held: dict[int, tuple[bytes, bool]] = {}
        self.waiting: dict[int, tuple[bytes, bool]] = {}
        self.done: dict[int, tuple[bytes, bool]] = {}
        self.row: dict | None = None

    @staticmethod
    def whole(pieces: dict[int, tuple[bytes, bool]]) -> bytes | None:
        """The datagram if the pieces cover it from its first byte to its last; overlaps may lie in it."""
        out = bytearray()
        size = next((at + len(d) for at, (d, more) in pieces.items() if not more), None)
        if size is None or 0 not in pieces:
            return None
        for at in sorted(pieces):
            if at > len(out):
                return None
            out += pieces[at][0][len(out) - at :]
        return bytes(out[:size]) if len(out) >= size else None

    def _finish(self, pieces: dict) -> list[dict]:
        data = self.whole(pieces)
        if data is None:
            return []
        self.done, self.held, self.waiting = pieces, {}, {}
        return [{**self.row, "at": 0, "more": False, "data": data}]

    def end(self) -> list[dict]:
        """What the fragments in hand make up with those that wait, if nothing follows."""
        found = self._finish({**self.waiting, **self.held}) if self.held and self.waiting else []
        self.held, self.waiting = {}, {}
        return found

    def add(self, row: dict) -> list[dict]:
        """Take a fragment; the datagrams that are complete by it."""
        at, piece, ended = row["at"], (row["data"], row["more"]), []
        if not self.held and self.done.get(at) == piece:
            self.waiting[at], self.row = piece, row
            return self._finish(dict(self.waiting))
        if self.held.get(at, piece) != piece:
            ended = self.end()
        self.held[at], self.row = piece, row
        return ended + self._finish(dict(self.held))


def rejoin(pieces: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """Fragments (columns of ``SCHEMA``) to whole datagrams, each at the frame that completes it."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, hand, schema = None, None, Assembly(), None
        for batch in batches:
            rows, schema = [], batch.schema
            for row in batch.to_pylist():
                own = tuple(row[c] for c in KEY)
                if own != key or (last is not None and row["ts_epoch"] is not None and abs(row["ts_epoch"] - last) > gap_s):
                    rows += hand.end()
                    key, hand = own, Assembly()
                last = row["ts_epoch"]
                if row["data"] and row["at"] + len(row["data"]) <= MOST_BYTES:
                    rows += hand.add(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if rest := hand.end():
            yield pa.RecordBatch.from_pylist(rest, schema)

    return pieces.select(*_COLUMNS).repartition(*KEY).sortWithinPartitions(*KEY, "frame_number").mapInArrow(fold, SCHEMA)
