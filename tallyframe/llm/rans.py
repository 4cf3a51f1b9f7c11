"""Token ids in binary files under a static range asymmetric numeral system.

One pass tokenizes every text once: it stores the ids of each text (16 bits each where the vocabulary allows) and counts them, which makes the
shared table of frequencies (2^SCALE in all, at least 1 for each id that occurs). A second range-partitions the stored ids by document, sorts them, and
writes parts of about part_tokens ids (whole texts). In a part,
blocks of BLOCK ids are coded independently by LANES interleaved states that share one run of 32-bit words; every STEPS steps
a checkpoint holds the states and the place in the words, so a block can be decoded from several places at once; each block has the CRC-32 of
its ids. The files are Parquet rows (file, part, ids before it in the file, texts' ids and lengths, payload) in the folder `parts` beside the folder
`frequencies`, so a reader needs the folder and nothing else.

At scale: texts are not shuffled, their ids are, once. What reaches the driver is bounded: a count for each id of the vocabulary, and one total for each file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer, vocabulary
from .common import documents, runs, shared_dir, stored

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK = 1 << 16
LANES = 64
STEPS = 256
PART_TOKENS = 1 << 21
END = 2
MAGIC = b"TRS1"
BATCH_BYTES = 24_000_000
#: Words that are handed to the library as one text.
TOGETHER = 20
#: Pieces, and bytes of whole texts, that are encoded or looked up at once: the library's encodings take a hundred times the ids' memory.
GROUP, GROUP_BYTES = 20_000, 1_000_000
#: A text of which every run of white space is one space or line break between two other characters is cut there; its
#: pieces are tokenized on their own just as in the whole text. All white space but these two makes a text odd.
_ODD = r"[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A[ \n]|[ \n]\z|[ \n][ \n]"
#: Stands before the first piece of a text; texts that have it are odd.
_FIRST = "\x00"


class Ids:
    """Ids of whole texts by their distinct pieces: each piece of a batch is encoded once."""

    def __init__(self, contents: str) -> None:
        self.of = tokenizer(contents)
        vocab = self.of.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.size[i] = len(piece)  # the vocabulary has a character for each byte
        self.kind = np.dtype(">u2" if len(self.size) <= 1 << 16 else ">u4")

    def _encoded(self, texts: list[str]) -> np.ndarray:
        """Ids of texts one after another."""
        found = [e.ids for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), np.uint32, sum(map(len, found)))

    def _pieces(self, names: pa.StringArray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each piece's ids end."""
        words = names.to_pylist()
        # a piece starts with its line break, or with the space that split it off; the first pieces of texts stand alone
        words = [w[1:] for w in words] if alone else [w if w[:1] == "\n" else " " + w for w in words]
        ids = self._encoded(words if alone else ["".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)])
        size = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        return ids, np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size), "right")

    def pieces(self, names: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each piece's ids begin and end."""
        first = pc.starts_with(names, _FIRST).to_numpy(zero_copy_only=False)
        spans, all_ids, done = np.zeros((2, len(names)), np.int64), [np.zeros(0, np.uint32)], 0
        for alone in (False, True):
            own = np.flatnonzero(first == alone)
            for s in range(0, len(own), GROUP):
                at = own[s : s + GROUP]
                ids, ends = self._pieces(names.take(pa.array(at)), alone)
                spans[0, at], spans[1, at] = done + np.append(0, ends[:-1]), done + ends
                all_ids.append(ids)
                done += len(ids)
        return np.concatenate(all_ids), spans

    def texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's; null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd)
        plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy() > 0))
        n = np.zeros(len(texts), np.int64)
        ids, spans, codes = np.zeros(0, np.uint32), np.zeros((2, 0), np.int64), np.zeros(0, np.int32)
        count = np.zeros(len(texts), np.int64)  # pieces of each plain text
        if len(plain):
            marked = pc.binary_join_element_wise(_FIRST, texts.take(pa.array(plain)), "")
            parts = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
            count[plain] = np.diff(parts.offsets.to_numpy())
            coded = parts.flatten().dictionary_encode()
            del marked, parts
            codes, names = coded.indices.to_numpy().astype(np.int32), coded.dictionary
            del coded
            ids, spans = self.pieces(names)
        found: dict[int, np.ndarray] = {}
        long = pc.binary_length(texts).to_numpy()[whole]
        for part in np.split(whole, np.flatnonzero(np.diff(np.cumsum(long) // GROUP_BYTES)) + 1):
            if len(part):
                encoded = self.of.encode_batch_fast(texts.take(pa.array(part)).to_pylist(), add_special_tokens=False)
                found.update((k, np.array(e.ids, np.uint32)) for k, e in zip(part.tolist(), encoded, strict=True))
                del encoded
        n[whole] = [len(found[k]) for k in whole.tolist()]
        size = (spans[1] - spans[0]).astype(np.int32)
        ends = np.cumsum(count)
        made = [np.zeros(0, np.uint32)]
        # texts in runs of about GROUP pieces, so that what stands beside the ids stays small
        for run in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // GROUP)) + 1):
            if not len(run):
                continue
            own = codes[ends[run[0]] - count[run[0]] : ends[run[-1]]]
            length = size[own].astype(np.int64)
            before = np.cumsum(length) - length
            flat = ids[np.repeat(spans[0][own] - before, length) + np.arange(length.sum())]
            until = np.append(before, len(flat))[ends[run] - (ends[run[0]] - count[run[0]])]
            begin = np.append(0, until[:-1])
            odd_here = run[odd[run]]
            n[run[~odd[run]]] = (until - begin)[~odd[run]]
            at = 0
            for k in odd_here.tolist():
                to = until[k - run[0]]
                made += [flat[at:to], found.pop(k)]
                at = to
            made.append(flat[at:])
        return np.concatenate(made), n


def _binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(n * ids.dtype.itemsize)])
    if offsets[-1] >= 1 << 31:
        return pa.array([x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.tobytes())])


TOKENS = "id bigint, ids binary, counts binary"


def _tokenized(contents) -> Callable:
    """(id, ids) of each text, and one row with the counts of all ids of the task's texts, the end's included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Ids(contents.value)
        total, texts = np.zeros(max(len(of.size), END + 1), np.int64), 0
        for held in runs(batches, 1, BATCH_BYTES):
            ids, n = of.texts(held.column(1).combine_chunks())
            total += np.bincount(ids, minlength=len(total))
            texts += len(n)
            yield pa.RecordBatch.from_arrays([held.column(0).combine_chunks(), _binary(ids.astype(of.kind), n), pa.nulls(len(n), pa.binary())], ["id", "ids", "counts"])
        total[END] += texts
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["id", "ids", "counts"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            one = np.frombuffer(x, "<i8")
            total = one.copy() if not len(total) else total + one
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])


def frequencies(counts: dict[int, int], size: int, scale: int = SCALE) -> np.ndarray:
    """Counts to frequencies that sum to 2^scale, at least 1 for each id that occurs."""
    c = np.zeros(size, np.int64)
    for k, n in counts.items():
        c[k] = n
    whole, used = 1 << scale, int((c > 0).sum())
    if not used:
        return c
    f = np.where(c > 0, 1 + (c.astype(float) / c.sum() * (whole - used)).astype(np.int64), 0)
    f[int(np.argmax(c))] += whole - int(f.sum())
    return f


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE) -> None:
        self.scale = np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        self.before = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)
        self.filler = int(np.argmax(freq)) if len(freq) else 0

    def _code(self, ids: np.ndarray) -> list[bytes]:
        """Blocks of equal length, a row each."""
        blocks, n = ids.shape
        steps = -(-n // LANES)
        x = np.full((blocks, steps * LANES), self.filler, np.uint32)
        x[:, :n] = ids
        x = x.reshape(blocks, steps, LANES)
        state = np.full((blocks, LANES), LOW, np.uint64)
        gave = np.zeros((blocks, steps, LANES), bool)
        words = np.zeros((blocks, steps, LANES), np.uint32)
        marks: dict[int, np.ndarray] = {}
        top = np.uint64(63 - int(self.scale))
        for s in range(steps - 1, -1, -1):
            f = self.freq[x[:, s]]
            full = (state >> top) >= f
            gave[:, s] = full
            words[:, s] = state.astype(np.uint32)
            state = np.where(full, state >> np.uint64(32), state)
            q = state // f
            state = (q << self.scale) + (state - q * f) + self.before[x[:, s]]
            if s % STEPS == 0:
                marks[s] = state.copy()
        sent = gave.sum(2).cumsum(1)
        out = []
        for b in range(blocks):
            body = words[b][gave[b]].astype("<u4").tobytes()
            inner = b"".join(struct.pack("<I", int(sent[b, s - 1]) if s else 0) + marks[s][b].astype("<u8").tobytes() for s in sorted(marks))
            out.append(struct.pack("<IIII", n, len(marks), len(body), zlib.crc32(ids[b].astype("<u4").tobytes())) + inner + body)
        return out

    def encode(self, ids: np.ndarray) -> bytes:
        """The payload of a part."""
        whole = len(ids) // BLOCK
        out: list[bytes] = []
        for s in range(0, whole, 32):
            out += self._code(ids[s * BLOCK : min(whole, s + 32) * BLOCK].reshape(-1, BLOCK))
        if len(ids) % BLOCK:
            out += self._code(ids[whole * BLOCK :][None])
        return MAGIC + struct.pack("<I", len(out)) + b"".join(out)

    def decode(self, payload: bytes) -> np.ndarray:
        """All ids of a payload, decoded from all checkpoints side by side; a wrong checksum raises ValueError."""
        if payload[:4] != MAGIC:
            raise ValueError("not a part of token ids")
        at, heads, states, places, words, steps, base = 8, [], [], [], [], [], 0
        for _ in range(struct.unpack_from("<I", payload, 4)[0]):
            n, marks, size, crc = struct.unpack_from("<IIII", payload, at)
            at += 16
            for k in range(marks):
                places.append(base + struct.unpack_from("<I", payload, at)[0])
                states.append(np.frombuffer(payload, "<u8", LANES, at + 4))
                steps.append(min(STEPS, -(-n // LANES) - k * STEPS))
                at += 4 + 8 * LANES
            words.append(np.frombuffer(payload, "<u4", size // 4, at))
            base += size // 4
            heads.append((n, marks, crc))
            at += size
        if not heads:
            return np.zeros(0, np.uint32)
        flow = np.append(np.concatenate(words), np.zeros(LANES, np.uint32)).astype(np.uint64)
        state, place, left = np.array(states, np.uint64), np.array(places), np.array(steps)
        found = np.zeros((len(states), STEPS, LANES), np.uint32)
        slot_mask = np.uint64((1 << int(self.scale)) - 1)
        for s in range(int(left.max())):
            live = np.flatnonzero(left > s)
            x = state[live]
            slot = x & slot_mask
            sym = self.symbol[slot]
            found[live, s] = sym
            x = self.freq[sym] * (x >> self.scale) + slot - self.before[sym]
            low = x < LOW
            nth = low.cumsum(1)
            take = flow[np.minimum(place[live][:, None] + nth - 1, len(flow) - 1)]
            state[live] = np.where(low, (x << np.uint64(32)) | take, x)
            place[live] += nth[:, -1]
        out, k = [], 0
        begun = np.array(states, np.uint64)
        for n, marks, crc in heads:
            if (state[k : k + marks] != np.append(begun[k + 1 : k + marks], np.full((1, LANES), LOW), axis=0)).any():
                raise ValueError("a block's checksum is wrong: its states don't meet")
            ids = found[k : k + marks].reshape(-1)[:n]
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum is wrong")
            out.append(ids)
            k += marks
        return np.concatenate(out)


FILE = "file int, part int, before bigint, n_tokens bigint, ids array<bigint>, lengths array<bigint>, payload binary"


def _written(freq, kind: str, part_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, coder = TaskContext.get().partitionId(), Coder(freq.value)
        part = before = 0

        def row(ids: list, arrays: list[np.ndarray], n: int) -> pa.RecordBatch:
            values = [[file], [part], [before], [n], [ids], [[len(a) for a in arrays]], [coder.encode(np.concatenate(arrays))]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in FILE.split(", ")])

        ids: list = []
        arrays: list[np.ndarray] = []
        n = 0
        for b in batches:
            for i, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                arrays.append(np.append(np.frombuffer(a, kind).astype(np.uint32), np.uint32(END)))
                n += len(arrays[-1])
                if n >= part_tokens:
                    yield row(ids, arrays, n)
                    part, before, ids, arrays, n = part + 1, before + n, [], [], 0
        if ids:
            yield row(ids, arrays, n)

    return run


def _read(freq) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for b in batches:
            for r in b.to_pylist():
                ids = coder.decode(r["payload"]).astype("<u4")
                ends = np.cumsum(r["lengths"])
                crcs = [zlib.crc32(x.tobytes()) for x in np.split(ids, ends[:-1])]
                values = [[r["file"]] * len(ends), r["ids"], r["before"] + ends - r["lengths"], r["lengths"], crcs]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), *[pa.int64()] * 4), strict=True)], ["file", "id", "start", "n_tokens", "ids_crc32"])

    return run


def write_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contents: str | None = None, path: str | None = None, part_tokens: int = PART_TOKENS) -> str:
    """Write the ids of all texts in ascending order of id, and the frequency table that decodes them; returns the folder.

    Null and empty texts have the end id only; null ids come first; rows of one id stand by their token ids; an empty table makes no parts.
    """
    spark = docs.sparkSession
    contents = contents or vocabulary("byte_bpe_50k.json")
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(contents)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    tokens = stored(rows.mapInArrow(_tokenized(shared), TOKENS), "token-ids")
    counts = tokens.where("counts is not null").select("counts").mapInArrow(_counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    of = Ids(contents)
    freq = frequencies({r["token"]: r["n"] for r in counts.collect()}, max(END + 1, len(of.size)))  # as long as the vocabulary at most
    spark.createDataFrame([(int(k), int(freq[k])) for k in np.flatnonzero(freq)], "token bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/frequencies")
    ordered = tokens.where("ids is not null").select("id", "ids").repartitionByRange("id").sortWithinPartitions("id", "ids")
    ordered.mapInArrow(_written(spark.sparkContext.broadcast(freq), of.kind.str, part_tokens), FILE).write.option("compression", "none").parquet(f"{path}/parts")
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each text, decoded from the files of a folder."""
    table = {r["token"]: r["frequency"] for r in spark.read.schema("token bigint, frequency bigint").parquet(f"{path}/frequencies").collect()}  # as long as the vocabulary at most
    freq = np.zeros(max(table, default=-1) + 1, np.int64)
    for k, n in table.items():
        freq[k] = n
    files = spark.read.schema(FILE).parquet(f"{path}/parts")
    totals = sorted((r[0], r[1]) for r in files.groupBy("file").agg(F.sum("n_tokens")).collect())  # one row a file
    starts, n = [], 0
    for file, tokens in totals:
        starts.append((file, n))
        n += tokens
    base = spark.createDataFrame(starts, "file int, base bigint")
    found = files.mapInArrow(_read(spark.sparkContext.broadcast(freq)), "file int, id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(base), "file").select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(spark, write_files(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")
