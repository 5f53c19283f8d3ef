"""Capture files made of the driver tables' packets, for queries that read real files."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

#: Link type and snap length of the files.
ETHERNET, SNAP = 1, 65535


class _File:
    """A classic capture under a name of its own until it is whole, so a task may be run again."""

    def __init__(self, name: str):
        self.system, self.path = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.part)
        self.out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, SNAP, ETHERNET))

    def add(self, micros: int, frame: bytes, size: int) -> None:
        self.out.write(struct.pack("<IIII", *divmod(micros, 1_000_000), len(frame), size) + frame)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


def write_captures(frames: DataFrame, root: str) -> None:
    """Write (capture, micros, place, part, frame, size) as ``root``/part-<capture>.pcap, by place and part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or row["capture"] != at:
                    if out:
                        out.close()
                    at, out = row["capture"], _File(f"{root}/part-{row['capture']}.pcap")
                out.add(row["micros"], row["frame"], row["size"])
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))
        if out:
            out.close()

    rows = frames.select("capture", "micros", "place", "part", "frame", "size")
    rows.repartition("capture").sortWithinPartitions("capture", "place", "part").mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()
