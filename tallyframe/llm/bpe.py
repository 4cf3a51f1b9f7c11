"""BPE encoding and decoding over a distinct-word table.

Texts are split at white space, where no token of the vocabulary crosses. A batch of texts (BATCH_CHARS characters, or what a
partition has left) makes a dictionary of its words; texts become codes into it. The words of all dictionaries meet
by word, sorted, and each distinct word is encoded once. Its ids go back to the places of the word by (batch, code), where
every text is put together from the ids of its words; decoding takes each id's piece from the id-to-piece table.

At scale: a word that stands in every text is one row a batch, so no key is hot. A batch is of bounded size, but for a text that is longer
by itself. Only the vocabulary file, the same for any input, is broadcast. Texts are read twice: batches carry the
checksum of their dictionary as key, so a source that gives other rows on the second reading stops the job instead of giving wrong ids.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .packing import pack, unpack

BATCH_CHARS = 32_000_000
WORD_ROWS = 50_000
PACK_ROWS = 500_000
#: White space for Python that is none for the vocabulary's patterns.
_OTHER = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _OTHER.search(text) else text.split()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file's contents; a path is taken as it is, other names are looked up among the public tokenizers."""
    import os

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as f:
        return f.read()


def tokenizer(contents: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(contents)
    t.no_truncation()
    t.no_padding()
    return t


def _key(words: dict) -> int:
    h = hashlib.blake2b(digest_size=8)
    for w in words:
        h.update(w.encode("utf-8", "surrogatepass") + b" ")
    return int.from_bytes(h.digest(), "little", signed=True)


def _batches(source: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows (id, text) in runs of at least `most` characters."""
    held, size = [], 0
    for b in source:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.append((i, t or ""))
            size += len(t or "")
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _coded(most: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(source, most):
            words: defaultdict = defaultdict(count().__next__)
            ids, blobs = [], []
            for i, text in rows:
                ids.append(i)
                blobs.append(pack(np.array(list(map(words.__getitem__, words_of(text))), np.uint32)))
            key = _key(words)
            for s in range(0, len(ids), 2000):
                part = blobs[s : s + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.array(ids[s : s + 2000], pa.int64()), pa.array(part, pa.binary())], ["batch", "id", "codes"])

    return run


def _dictionaries(most: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(source, most):
            words: dict = {}
            for _, text in rows:
                words.update(dict.fromkeys(words_of(text)))
            key, names = _key(words), list(words) or [""]  # a batch without words still has one row
            for s in range(0, len(names), WORD_ROWS):
                part = names[s : s + WORD_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.array(range(s, s + len(part)), pa.int32()), pa.array(part, pa.string())], ["batch", "code", "word"])

    return run


def _encoded(contents) -> Callable:
    """Sorted rows (batch, code, word) to rows (batch, packed codes and ids): each distinct word is encoded once."""

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        batch, code, place = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
        names = [x for h in held for x in h[3]]
        size = np.fromiter(map(len, names), np.int64, len(names)) // 2
        order = np.lexsort((code, batch))
        batch, code, place = batch[order], code[order], place[order]
        for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(batch)) + 1):
            ids = np.frombuffer(b"".join([names[k] for k in place[part].tolist()]), "<u2")
            blob = pack(np.diff(code[part], prepend=0).astype(np.uint32), size[place[part]].astype(np.uint32), ids)
            yield pa.RecordBatch.from_arrays([pa.array([int(batch[part[0]])], pa.int64()), pa.array([blob], pa.binary())], ["batch", "words"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(contents.value)
        last_word, last_ids = None, b""
        held, rows, known = [], 0, 0
        for b in source:
            if not b.num_rows:
                continue
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            coded = pc.dictionary_encode(column("word"))
            names = coded.dictionary.to_pylist()
            fresh = [w for w in names if w != last_word]
            got = dict(zip(fresh, (np.array(e.ids, "<u2").tobytes() for e in t.encode_batch_fast(fresh, add_special_tokens=False)), strict=True)) if fresh else {}
            if last_word in names:
                got[last_word] = last_ids
            last_word = column("word")[b.num_rows - 1].as_py()
            last_ids = got[last_word]
            held.append((column("batch").to_numpy(), column("code").to_numpy(), coded.indices.to_numpy() + known, [got[w] for w in names]))
            rows, known = rows + b.num_rows, known + len(names)
            if rows >= PACK_ROWS:
                yield from packed(held)
                held, rows, known = [], 0, 0
        if held:
            yield from packed(held)

    return run


def _assembled(contents, full: bool) -> Callable:
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        t = tokenizer(contents.value)
        piece = {i: p.encode() for p, i in t.get_vocab(with_added_tokens=True).items()}  # the id-to-piece table
        found = [unpack(x) for x in words.column("words").to_pylist()]
        code = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(x[0], dtype=np.int64) for x in found]])
        kinds = np.unique(code)  # batches of equal dictionaries have one key, and the same ids more than once
        if docs.num_rows and (not len(kinds) or kinds[-1] != len(kinds) - 1):
            raise ValueError("a batch and its dictionary differ: the source gave other rows when it was read again")
        ids = [b""] * len(kinds)
        at = 0
        for _, size, x in found:
            end = np.cumsum(size, dtype=np.int64) * 2
            raw = x.tobytes()
            for c, s, e in zip(code[at : at + len(size)].tolist(), (end - size * 2).tolist(), end.tolist(), strict=True):
                ids[c] = raw[s:e]
            at += len(size)
        pieces = [b" ".join([piece[k] for k in np.frombuffer(x, "<u2").tolist()]) for x in ids]
        blank = not all(ids)
        out: list[list] = [[], [], [], [], [], []]
        for i, blob in zip(docs.column("id").to_pylist(), docs.column("codes").to_pylist(), strict=True):
            codes = unpack(blob)[0].tolist()
            tokens = np.frombuffer(b"".join([ids[c] for c in codes]), "<u2").astype("<u4")
            text = b" ".join([pieces[c] for c in codes if not blank or ids[c]])
            for k, x in enumerate((i, len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest(), tokens.tolist() if full else None, text.decode() if full else None)):
                out[k].append(x)
        return pa.table([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()), strict=True)], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contents: str | None = None, full: bool = True, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, and if full: ids, decoded) for each row of docs.

    Null, empty and blank texts have no ids and decode to the empty text. Null ids stay null, repeated rows stay repeated, an empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(contents or vocabulary())
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(_dictionaries(batch_chars), "batch bigint, code int, word string").repartition("word").sortWithinPartitions("word")
    known = words.mapInArrow(_encoded(shared), "batch bigint, words binary")
    coded = rows.mapInArrow(_coded(batch_chars), "batch bigint, id bigint, codes binary")
    out = coded.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(_assembled(shared, full), "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<bigint>, decoded string")
    out = out.withColumnRenamed("id", id_col)
    return out if full else out.drop("ids", "decoded")


def pieces(spark: SparkSession, contents: str | None = None) -> DataFrame:
    """(id, piece): the id-to-piece table, as long as the vocabulary."""
    vocab = tokenizer(contents or vocabulary()).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in vocab.items()), "id bigint, piece string")


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", contents: str | None = None) -> DataFrame:
    """(id, decoded) by a join of the ids with the id-to-piece table (of the vocabulary's length, hence broadcast).

    Rows are told apart by id and ids; null and empty ids decode to the empty text, ids without a piece are passed over.
    """
    table = F.broadcast(pieces(tokens.sparkSession, contents))
    rows = tokens.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.array()).alias("_ids"))
    placed = rows.select("_id", F.xxhash64("_ids").alias("_h"), F.posexplode_outer("_ids").alias("_pos", "id")).join(table, "id", "left")
    joined = placed.groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_pos", "piece")))).alias("found"))
    return joined.select(F.col("_id").alias(id_col), F.array_join("found.piece", " ").alias("decoded"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), full=False)
