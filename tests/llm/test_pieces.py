"""SentencePiece operator against the library, and spans against the source."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from tapline.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, ids int, decoded string"


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(open(PATH, "rb").read())


def texts():
    rng = random.Random(3)
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\nb ", "\t x", "▁", "▁ ▁a", "a▁b", "naïve café", "日本語 テキスト", "👩‍👩‍👧 emoji", "\x00\x01", "x" * 300, "<s> </s> <unk>", "ﬁ ½ Å", " a　b", "12345 67"]
    pool = ["the", "été", " ", "  ", "\n", "数", "👍", "▁", ".", "x1"]
    return odd + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_ids_and_decoding_equal_the_library(encoder):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts():
        ids, _, _ = encoder.encode(text)
        assert ids.tolist() == sp.encode(text)
        assert encoder.decode(ids) == sp.decode(sp.encode(text))


def test_parts_give_the_same_pieces(encoder, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for size in (1, 3, 7):
        monkeypatch.setattr(P, "PART_BYTES", size)
        for text in texts():
            assert encoder.encode(text)[0].tolist() == sp.encode(text), (size, text)


def test_spans_tile_the_source_bytes(encoder):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts():
        ids, begins, ends = encoder.encode(text)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw
        for i, a, b in zip(ids.tolist(), begins, ends, strict=True):
            piece = sp.id_to_piece(i)
            if not sp.is_byte(i) and raw[a:b].decode() != piece.replace("▁", " "):
                assert a == 0 or "▁" in text


def darts(table: dict[bytes, bytes]) -> bytes:
    """A compiled character map with one node a slot, for the test's few short keys."""
    blob, values = b"", {}
    for key, new in table.items():
        values[key] = len(blob)
        blob += new + b"\0"
    nodes = {b""} | {k[:i] for k in table for i in range(1, len(k) + 1)}
    units = [0] * (256 * 256)
    base = {node: 256 * (k + 1) for k, node in enumerate(sorted(nodes))}

    def link(place: int, node: bytes, label: int) -> None:
        offset = base[node] ^ place
        units[place] = label | (0x100 if node in values else 0) | (offset << 10)
        if node in values:
            units[base[node]] = values[node] | 0x80000000

    link(0, b"", 0)
    for node in sorted(nodes - {b""}):
        link(base[node[:-1]] ^ node[-1], node, node[-1])
    raw = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(raw)) + raw + blob


def test_longest_prefix_of_the_character_map():
    table = {b"a": b"1", b"ab": b"22", b"abc": b"", "ﬁ".encode(): b"fi", b"xyz": b"Z"}
    m = P.CharacterMap(darts(table))
    assert m.longest(b"abd", 0) == (2, b"22") and m.longest(b"abc", 0) == (3, b"") and m.longest(b"xy", 0) is None
    assert m.longest("ﬁ".encode(), 0) == (3, b"fi") and m.longest(b"zab", 1) == (2, b"22") and P.CharacterMap(b"").longest(b"a", 0) is None


def test_mapped_text_keeps_its_source(encoder):
    other = P.Encoder(open(PATH, "rb").read())
    other.map, other.plain = P.CharacterMap(darts({"ﬁ".encode(): b"fi", b"\t": b" "})), False
    clean, back = other.normalised("aﬁ\t b".encode())
    assert clean.decode() == "▁afi▁▁b" and back.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 4, 5, 5, 5, 6, 7]
    other.spec.remove_extra_whitespaces = True
    clean, back = other.normalised("  aﬁ\t b ".encode())
    assert clean.decode() == "▁afi▁b" and len(back) == len(clean) + 1


def test_rows(spark):
    rows = [(1, None, 0, ""), (1, None, 0, ""), (None, "a b", 0, ""), (3, "été " * 5000, 0, "")]
    out = P.digests(P.encode(spark.createDataFrame(rows, SCHEMA), PATH)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert P.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []
