import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import token_records as T
from shelfmark.llm.common import new_folder, tokenizer_file
from shelfmark.llm.crc32c import crc32c, masked
from shelfmark.llm.units import UNIT, UnitEncoder, blocks

PATH = tokenizer_file("byte_bpe_50k.json")


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_crc32c():
    assert slow_crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(0)
    parts = [rng.bytes(n) for n in (0, 1, 3, 4, 63, 64, 65, 127, 128, 129, 1000, 4099)]
    assert crc32c(parts).tolist() == [slow_crc32c(p) for p in parts]
    assert len(crc32c([])) == 0 and masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def test_units_match_whole_texts():
    t = Tokenizer.from_file(PATH)
    e = UnitEncoder(PATH, cache_units=40)
    for x in ["", " ", "a  b\n\n c\t d ", "it's we'll I'M x's", " x　 y \x1c z\x85w", "1,234.5 é😀 a\r\nb", "<|endoftext|> x", "x  <|endoftext|>\n y<|endoftext|><|endoftext|>z", "<|endoftext|", "a <| endoftext|> <|endoftext|>", "  lead", "tail  \n", "ab " * 500]:
        assert np.frombuffer(e.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, x
        assert "".join(UNIT.findall(x)) == x
        assert "".join(blocks(x, 7)) == x
        assert [u for b in blocks(x, 7) for u in UNIT.findall(b)] == UNIT.findall(x)
        assert "".join(e.units(x)) == x


def test_round_trip(spark):
    rows = [(5, "hello world"), (1, None), (2, ""), (3, "long word " * 20_000), (5, "hello world"), (5, "again"), (None, "no id"), (4, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    folder = new_folder(spark, "t")
    m = T.write_records(docs, folder, PATH, n_files=3)
    got = T.read_records(m, folder, with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == brute(rows)
    one = m.orderBy("file_no").first()
    key, ids = T.fetch_record(folder, one.path, 1)
    assert key == got[1].doc_id and ids.tolist() == got[1].ids
    empty = new_folder(spark, "t")
    assert T.read_records(T.write_records(docs.limit(0), empty, PATH), empty).count() == 0


def test_corruption_is_found():
    good = b"".join(T.frame([b"abc", b"", b"defg"]))
    assert T.unframe(good, [3, 0, 4]) == [b"abc", b"", b"defg"]
    for at in (0, 9, 13, 17):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            T.unframe(bytes(bad), [3, 0, 4])


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [tuple(r) for r in T.op6_token_records(spark, sf).orderBy("start").collect()] == brute(rows)
