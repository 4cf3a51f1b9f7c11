"""BPE and token files against the library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import bpe, rans

TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "  a  b ", "a\nb", "a\n\nb", "a \n b", "don't WE'LL 'tis", "é ü 中文字 😀x", "é i\x1cj\x1f k", "<|endoftext|>", "x <|startoftext|> y<|endoftext|>z",
    "1234 5 67,89. !!! ... ", "a\tb c\u2028d", "İSTANBUL Σίσυφος ΣΑΣ", "ab" * 3000,
]
ROWS = [*enumerate(TEXTS), (3, "\n"), (3, "repeated"), (3, "repeated"), (None, "no id")]
DDL = "doc_id bigint, text string, batch int, code string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "i") for i, t in rows], DDL)


@pytest.mark.parametrize("batch", [1, 40, 10**7])
def test_word_table_equals_the_library(spark, batch):
    t = bpe.tokenizer(bpe.vocabulary())
    r = random.Random(5)
    rows = ROWS + [(100 + k, " ".join(r.choices(["the", "Theory,", "x.", "zz9", "naïve"], k=30))) for k in range(20)]
    got = bpe.encoded(frame(spark, rows), batch_chars=batch).collect()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encoded(frame(spark, [])).collect() == []


def test_decoding_by_the_piece_table(spark):
    t = bpe.tokenizer(bpe.vocabulary())
    ids = {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(TEXTS)}
    got = bpe.decoded(spark.createDataFrame(list(ids.items()), "doc_id int, ids array<bigint>")).collect()
    assert {x["doc_id"]: x["decoded"] for x in got} == {k: t.decode(v, skip_special_tokens=False) for k, v in ids.items()}


def test_token_files_hold_what_the_library_gives(spark):
    t = rans.tokenizer(bpe.vocabulary("byte_bpe_50k.json"))
    got = [tuple(x) for x in rans.read_files(spark, rans.write_files(frame(spark, ROWS))).orderBy("start").collect()]
    start, want = 0, []
    for i, x in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    empty = rans.write_files(frame(spark, []))
    assert spark.read.parquet(f"{empty}/parts").count() == 0 and rans.read_files(spark, empty).collect() == []


def test_many_parts_and_a_long_text(spark):
    t = rans.tokenizer(bpe.vocabulary("byte_bpe_50k.json"))
    r = random.Random(8)
    rows = [(k, " ".join(r.choices(["the", "Theory,", "x.", "zz9", "naïve", "don't", "a\nb"], k=r.randint(0, 60)))) for k in range(300)]
    rows.append((1000, " ".join(f"w{k}" for k in range(100_000))))
    path = rans.write_files(frame(spark, rows), part_tokens=500)
    assert spark.read.parquet(f"{path}/parts").agg({"part": "max"}).first()[0] > 2
    got = {x["id"]: (x["start"], x["n_tokens"], x["ids_crc32"]) for x in rans.read_files(spark, path).collect()}
    start = 0
    for i, x in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_ids_of_odd_texts_equal_the_library():
    of, r = rans.Ids(bpe.vocabulary("byte_bpe_50k.json")), random.Random(9)
    marks = ["a", "Be", "don't", "12", ",", "!!", " ", " ", " ", "\n", "\t", "\r", "\x00", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "é", "中", "😀", "<|endoftext|>", "'s"]
    texts = [None, "", *TEXTS, *["".join(r.choices(marks, k=r.randint(0, 30))) for _ in range(4000)]]
    ids, n = of.texts(pa.array(texts, pa.string()))
    for x, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == of.of.encode(x or "", add_special_tokens=False).ids, x


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, rans.STEPS * rans.LANES, rans.BLOCK - 1, rans.BLOCK, 3 * rans.BLOCK + 17])
def test_round_trip_and_checksum(n):
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 999).astype(np.uint32)
    freq = rans.frequencies(dict(enumerate(np.bincount(ids, minlength=1000).tolist())), 1000)
    assert freq.sum() in (0, 1 << rans.SCALE)
    if n:
        coder = rans.Coder(freq)
        payload = coder.encode(ids)
        assert (coder.decode(payload) == ids).all()
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            coder.decode(bytes(broken))


def test_only_one_symbol():
    coder = rans.Coder(rans.frequencies({7: 100}, 10))
    assert (coder.decode(coder.encode(np.full(100, 7, np.uint32))) == 7).all()
