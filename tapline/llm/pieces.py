"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix matches through the model's compiled character map,
and every normalised byte remembers the source byte it came from. The library segments the
text; the pieces laid end to end over the normalised bytes give every piece its span of
source bytes. Pieces that don't cover the normalised text exactly are an error, so the
alignment is checked on every text.

Cases: a null text counts as empty and has no pieces; repeated rows and null ids keep their
rows; an empty table gives no rows; long texts are segmented in parts cut where no piece of
the vocabulary can cross (one without spaces is one part); other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tapline.llm.common import blocks

#: Bytes of a text that the library segments at a time, where the vocabulary allows a cut.
PART_BYTES = 1 << 20
_SPACE = "▁"


class CharacterMap:
    """The model's compiled map: a double-array trie from source bytes to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        units, found = self.units, None
        if not units:
            return None

        def child(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node = child(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units) or units[node] & 0x800000FF != raw[k]:
                break
            unit = units[node]
            node ^= child(unit)
            if unit & 0x100:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        begin = found[1]
        return found[0], self.replacements[begin : self.replacements.index(b"\0", begin)]


class Encoder:
    """A model's normaliser, segmentation and piece spans."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spec = proto.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.widths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = proto.trainer_spec.unk_id
        # Parts may be cut before a space if no piece holds one after another character.
        crossing = any(_SPACE in p.piece.lstrip(_SPACE) for p in proto.pieces)
        self.plain = not self.map.units and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.plain = self.plain and not self.suffix
        self.cut = self.plain and self.spec.add_dummy_prefix and not crossing

    def normalised(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each and the end, the source byte it came from."""
        mark = _SPACE.encode()
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            source = np.frombuffer(raw, np.uint8)
            width = np.where(source == 32, len(mark), 1)
            prefix = mark if self.spec.add_dummy_prefix else b""
            back = np.concatenate([np.zeros(len(prefix), np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]])
            return prefix + raw.replace(b" ", mark), back
        return self._mapped(raw)

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        squeeze = self.spec.remove_extra_whitespaces
        space = _SPACE.encode() if self.spec.escape_whitespaces else b" "
        out, back, at = bytearray(), [], 0

        def step(at: int) -> tuple[int, bytes]:
            found = self.map.longest(raw, at)
            if found:
                return found
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            return size, raw[at : at + size]

        if squeeze:
            while at < len(raw):
                size, new = step(at)
                if new != b" ":
                    break
                at += size
        if at == len(raw):
            return b"", np.array([at])
        if self.spec.add_dummy_prefix and not self.suffix:
            out += space
            back += [at] * len(space)
        spaced = squeeze
        while at < len(raw):
            size, new = step(at)
            if spaced:
                new = new.lstrip(b" ")
            for k in range(len(new)):
                add = space if new[k : k + 1] == b" " else new[k : k + 1]
                out += add
                back += [at] * len(add)
            if new:
                spaced = squeeze and new.endswith(b" ")
            at += size
            if not squeeze:
                spaced = False
        end = at
        while squeeze and out.endswith(space):
            del out[-len(space) :]
            end = back[-1]
            del back[-len(space) :]
        if self.spec.add_dummy_prefix and self.suffix:
            out += space
            back += [end] * len(space)
        return bytes(out), np.array([*back, end], np.int64)

    def parts(self, text: str) -> Iterator[str]:
        """Texts whose pieces, one after another, are those of ``text``."""
        begin = 0
        while self.cut and len(text) - begin > PART_BYTES:
            at = begin + PART_BYTES
            while at < len(text) - 1 and not (text[at] == " " and text[at - 1] not in (" ", _SPACE) and text[at + 1] not in (" ", _SPACE)):
                at += 1
            if at >= len(text) - 1:
                break
            yield text[begin:at]
            # The space at the cut is the mark that the next part gets as its prefix.
            begin = at + 1
        yield text[begin:]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, begins and ends (source bytes) of the pieces of ``text``."""
        ids = np.array([i for part in self.parts(text) for i in self.library.encode(part)], np.int64)
        widths = self.widths[ids]
        if (ids == self.unknown).any():
            # An unknown piece stands for a stretch of text whose length only the library knows.
            widths = np.array([len(p.piece.encode()) for p in self.library.encode(text, out_type="immutable_proto").pieces], np.int64)
        clean, back = self.normalised(text.encode())
        edges = np.concatenate([[0], np.cumsum(widths)])
        if edges[-1] != len(clean):
            raise ValueError(f"pieces cover {edges[-1]} of {len(clean)} normalised bytes")
        return ids, back[edges[:-1]], back[edges[1:]]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins, ends (source bytes of each piece) and the decoded text of each row."""
    known = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    schema = "doc_id bigint, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(known.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
            for i, j in blocks(sizes):
                found = [encoder.encode(t or "") for t in texts[i:j]]
                edges = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([f[k] for f in found]).astype(kind))) for k, kind in enumerate((np.int32, np.int64, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists, pa.array([encoder.decode(f[0]) for f in found], pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
