"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of WINDOW words, each starting HALF words after the one before (letters and digits, lower case).
   One pass over all texts counts in how many passages each word of the benchmark stands (document frequencies).
2. The benchmark's passages, as TF-IDF rows, get a distributed randomised SVD: partitions return their part of
   A'(A X) for a random start X, the driver orthogonalises; two rounds. As many directions are kept as the passages span, RANK at most.
3. Every passage of every text is folded in; benchmark passages whose cosine with it reaches NEAR are candidates.
   Candidates about which no word of the item's rarest stands, or fewer of its words than it needs, are dropped: they can't count.
4. A candidate counts if the longest common subsequence with the item covers SURE of the item's words; or, for paraphrases,
   LIKELY of them and at least half of the item's ANSWER most telling words (highest IDF) stand in the place, too.

At scale: texts are not shuffled; two passes with the benchmark's words and directions broadcast. Both are bounded: words
beyond TERMS share slots, directions are RANK at most; items are compared in blocks. The benchmark is a stated query set against all rows.
Texts are split, looked up and folded in by the batch; only candidates are looked at one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, runs, table, trim

WINDOW, HALF = 64, 32
TERMS = 1 << 16
RANK = 1024
NEAR = 0.3
COMMON = 0.1
SURE, LIKELY, ANSWER = 0.7, 0.5, 6
ITEM_BLOCK = 4096
FOLDED = 2048
#: Bytes of texts that are split and folded in at once; it bounds what a worker holds, and a text is never cut.
BATCH_BYTES = 2_000_000
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&@/\\_-+=~^`"
_OTHER_MARKS = "«»“”„’‘…¿¡"
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(x) for x in _MARKS]] = 32


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after another, and the number of each text's words; null is empty."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    if not len(lower):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)
    spaced = pa.StringArray.from_buffers(len(lower), lower.buffers()[1], pa.py_buffer(_PLAIN[raw]), None, 0, lower.offset)
    if (raw == 0xC2).any() or (raw == 0xE2).any():
        for mark in _OTHER_MARKS:
            spaced = pc.replace_substring(spaced, mark, " ")
    parts = pc.utf8_split_whitespace(spaced)
    words = parts.flatten()
    real = pc.binary_length(words).to_numpy() > 0
    offsets = parts.offsets.to_numpy()
    before = np.concatenate([[0], np.cumsum(real)])
    return words.filter(pa.array(real)), np.diff(before[offsets - offsets[0]])


def words_of(text: str | None) -> list[str]:
    return split(pa.array([text], pa.string()))[0].to_pylist()


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of a (Hyyro)."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Coded:
    """Texts of a batch as codes of the benchmark's words (-1: none), cut into halves of HALF words.

    Passage h of a text is its halves h and h + 1; a text of one half has one passage. Halves of all texts stand one after
    another, with an empty one after each text.
    """

    def __init__(self, texts: pa.Array, names: pa.Array) -> None:
        words, self.n = split(texts)
        self.codes = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy().astype(np.int32)
        self.begin = np.cumsum(self.n) - self.n
        self.halves = -(-self.n // HALF)
        self.first = np.cumsum(self.halves + 1) - (self.halves + 1)  # each text's first half
        self.count = np.where(self.n > 0, np.maximum(self.halves - 1, 1), 0)  # passages
        place = np.arange(len(self.codes)) - np.repeat(self.begin, self.n)
        self.half = place // HALF + np.repeat(self.first, self.n)

    def passages(self) -> np.ndarray:
        """The first half of each passage."""
        return np.repeat(self.first - (np.cumsum(self.count) - self.count), self.count) + np.arange(self.count.sum())

    def frequencies(self, terms: int) -> np.ndarray:
        """In how many passages each term stands."""
        at = np.flatnonzero(self.codes >= 0)
        total = int((self.halves + 1).sum())
        key = np.sort(self.codes[at].astype(np.int64) % terms * total + self.half[at])
        key = key[np.diff(key, prepend=-1) != 0]
        half, term = key % total, key // total
        starts = np.zeros(total + 1, bool)  # halves that a passage starts with
        starts[self.passages()] = True
        both = np.append(np.diff(key) == 1, False) & starts[half]
        n = starts[half].astype(np.int64) + (starts[half - 1] & (half > 0)) - both
        return np.bincount(term, n, terms).astype(np.int64)


class Index:
    """The benchmark as its words, frequencies, directions and items; what is broadcast."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in words if w]
        self.names = pa.array(sorted({w for _, ws in self.items for w in ws}), pa.string())
        self.terms = min(TERMS, max(1, len(self.names)))
        self.idf = np.ones(self.terms, np.float32)
        code = {w: k for k, w in enumerate(self.names.to_pylist())}
        self.codes = [np.array([code[x] for x in w], np.int32) for _, w in self.items]

    def rows(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(text, terms, unit weights) for each passage of texts."""
        of, out = Coded(pa.array(texts, pa.string()), self.names), []
        for k, (s, n, passages) in enumerate(zip(of.begin, of.n, of.count, strict=True)):
            for h in range(passages):
                codes = of.codes[s + h * HALF : s + min(n, h * HALF + WINDOW)]
                term, times = np.unique(codes[codes >= 0] % self.terms, return_counts=True)
                w = times * self.idf[term]
                out.append((k, term, (w / max(1e-9, float(np.linalg.norm(w)))).astype(np.float32)))
        return out


def _frequencies(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        trim()
        total, passages = np.zeros(index.terms, np.int64), 0
        for b in runs(batches, 0, BATCH_BYTES):
            of = Coded(b.column(0).combine_chunks(), index.names)
            total += of.frequencies(index.terms)
            passages += int(of.count.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], passages), pa.int64())], ["term", "n"])

    return run


def _product(shared, start: np.ndarray) -> Callable:
    """A partition's part of A'(A X), as rows of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = shared.value, np.zeros_like(start)
        for b in batches:
            for _, term, v in index.rows(b.column(0).to_pylist()):
                out[term] += v[:, None] * (v @ start[term])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

    return run


def directions(benchmark: DataFrame, shared, index: Index, text_col: str = "text", rounds: int = 2, seed: int = 5, rank: int = RANK) -> np.ndarray:
    """(terms, rank) orthonormal directions: all that the benchmark's passages span, or the strongest `rank`."""
    n = sum(max(1, -(-len(w) // HALF) - 1) for _, w in index.items)
    width = max(1, min(n, index.terms, rank + 16))
    x = np.random.default_rng(seed).standard_normal((index.terms, width)).astype(np.float32)
    for _ in range(rounds):
        x = np.linalg.qr(x)[0].astype(np.float32)
        parts = benchmark.select(text_col).mapInArrow(_product(shared, x), "part binary").coalesce(8).collect()
        x = sum((np.frombuffer(p[0], np.float32).reshape(x.shape) for p in parts), np.zeros_like(x))
    left, size, _ = np.linalg.svd(x, full_matrices=False)
    keep = min(rank, int((size > 1e-6 * max(size[0], 1e-12)).sum()))
    return np.ascontiguousarray(left[:, : max(1, keep)], np.float32)


def weights(index: Index, df: np.ndarray, passages: int) -> np.ndarray:
    """IDF of each term; none where a term stands in more than COMMON of all passages, but for the words of items that mostly have such."""
    common = df > COMMON * passages
    for codes in index.codes:
        if 2 * common[codes % index.terms].sum() > len(codes):
            common[codes % index.terms] = False
    return np.where(common, 0, np.log((passages + 1) / (df + 1)) + 0.1).astype(np.float32)


def fitted(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> Index:
    spark = docs.sparkSession
    items = [(r[0], r[1]) for r in benchmark.select(item_col, "text").where(F.col(item_col).isNotNull() & F.col("text").isNotNull()).distinct().orderBy(item_col, "text").collect()]  # the query set
    index = Index(items)
    counts = docs.select(text_col).mapInArrow(_frequencies(spark.sparkContext.broadcast(index)), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
    found = {r[0]: r[1] for r in counts}
    df = np.array([found.get(k, 0) for k in range(index.terms)])
    index.idf = weights(index, df, found.get(-1, 0))
    index.axes = directions(benchmark.where("text is not null"), spark.sparkContext.broadcast(index), index)
    return finished(index)


def finished(index: Index) -> Index:
    """index with what candidates are searched and verified by, from its weights and directions."""
    rows = index.rows([" ".join(w) for _, w in index.items])
    index.latent = np.array([v @ index.axes[term] for _, term, v in rows], np.float32).reshape(len(rows), index.axes.shape[1])
    index.latent /= np.maximum(np.linalg.norm(index.latent, axis=1, keepdims=True), 1e-9)
    index.of = np.array([k for k, _, _ in rows], np.int64)
    index.axes *= index.idf[:, None]  # a word's weight and its directions in one
    names = index.names.to_pylist()
    rare = lambda c: sorted(set(c.tolist()), key=lambda x: (-float(index.idf[x % index.terms]), names[x]))
    index.answer = [set(rare(c)[:ANSWER]) for c in index.codes]
    index.weighs = np.append(index.idf[np.arange(len(names)) % index.terms] > 0, False)
    index.sizes = np.array([len(c) for c in index.codes], np.int64)
    index.members = np.array(sorted({k * (len(names) + 1) + x for k, c in enumerate(index.codes) for x in c.tolist()}), np.int64)
    pairs = []
    for k, c in enumerate(index.codes):
        count, taken, own = Counter(c.tolist()), 0, 0
        for x in rare(c):  # more tokens than an item may lose, and all words of the answer
            if taken > (1 - SURE) * len(c) and own >= ANSWER:
                break
            pairs.append((x, k))
            own, taken = own + 1, taken + count[x]
    pairs.sort()
    index.rare_items = np.array([k for _, k in pairs], np.int64)
    index.rare_at = np.searchsorted(np.array([x for x, _ in pairs], np.int64), np.arange(len(names) + 2))
    index.is_rarest = np.append(np.diff(index.rare_at)[:-1] > 0, False)
    return index


def _possible(index: Index, of: Coded, half: np.ndarray, text: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which candidates (a passage's first half, its text, an item) can count: a word of the item's rarest stands about the passage,
    as a place that counts has one (they are more than the item may lose), and a place has as many of the item's words as it needs."""
    at = np.flatnonzero(index.is_rarest[of.codes])  # code -1 is the last entry, which is False
    begin, end = index.rare_at[of.codes[at]], index.rare_at[of.codes[at] + 1]
    total = int((of.halves + 1).sum()) + 1
    items = index.rare_items[np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange((end - begin).sum())]
    near = np.sort(items * total + np.repeat(of.half[at], end - begin))
    reach = -(-index.sizes[k] // HALF)
    low = k * total + np.maximum(half - reach, of.first[text])
    high = k * total + np.minimum(half + 1 + reach, of.first[text] + of.halves[text])
    can = np.searchsorted(near, low) < np.searchsorted(near, high, "right")
    out = np.zeros(len(k), bool)
    for part in np.array_split(np.flatnonzero(can), max(1, int(can.sum()) // 20_000)):
        low, high, reach = _region(index, of, half[part], text[part], k[part])
        size = high - low
        if not size.sum():
            continue
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        codes = of.codes[np.repeat(low, size) + place]
        key = np.repeat(k[part], size) * (len(index.names) + 1) + codes
        found = np.minimum(np.searchsorted(index.members, key), len(index.members) - 1)
        hits = np.concatenate([[0], np.cumsum((index.members[found] == key) & (codes >= 0))])
        ends = np.cumsum(size)
        until = np.minimum(np.arange(len(codes)) + np.repeat(reach, size), np.repeat(ends, size))
        gain = np.maximum.reduceat(np.append(hits[until] - hits[:-1], 0), ends - size)
        out[part] = (gain >= LIKELY * index.sizes[k[part]]) & (size > 0)
    return out


def _region(index: Index, of: Coded, half: np.ndarray, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words about passages begin and end among all words of the batch, and the length of a place of the item."""
    m = index.sizes[k]
    word = (half - of.first[text]) * HALF
    return of.begin[text] + np.maximum(0, word - m), of.begin[text] + np.minimum(of.n[text], word + WINDOW + m), m + m // 4


def _verified(index: Index, region: np.ndarray, k: int) -> float:
    """Share of item k's words in the longest common subsequence with the best place of a region; 0 if it doesn't count."""
    item = index.codes[k]
    m = len(item)
    reach = m + m // 4
    hits = np.concatenate([[0], np.cumsum(np.isin(region, item))])
    gain = hits[np.minimum(np.arange(len(region)) + reach, len(region))] - hits[:-1]
    if not len(gain) or gain.max() < LIKELY * m:
        return 0.0
    s = int(gain.argmax())
    place = region[max(0, s - m // 8) : s + reach].tolist()
    share = common_length(item.tolist(), place) / m
    if share >= SURE:
        return share
    answer = index.answer[k]
    return share if share >= LIKELY and 2 * len(answer & set(place)) >= len(answer) else 0.0


def judge(index: Index, texts: pa.Array, near: float = NEAR) -> list[dict[int, float]]:
    """Item to share, for the items that stand in each text."""
    found: list[dict[int, float]] = [{} for _ in range(len(texts))]
    if not index.items or not len(texts):
        return found
    of = Coded(texts, index.names)
    passages, text = of.passages(), np.repeat(np.arange(len(texts)), of.count)
    at = np.flatnonzero(index.weighs[of.codes])  # code -1 is the last entry, which is False
    term, half = of.codes[at] % index.terms, of.half[at]
    near_passage, near_item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(passages), FOLDED):
        own = passages[s : s + FOLDED]
        a, b = np.searchsorted(half, [own[0], own[-1] + 2])
        folded = np.zeros((own[-1] + 2 - own[0], index.axes.shape[1]), np.float32)
        if a < b:
            begin = np.flatnonzero(np.diff(half[a:b], prepend=-1))
            folded[half[a:b][begin] - own[0]] = np.add.reduceat(index.axes[term[a:b]], begin)
        z = folded[own - own[0]] + folded[own - own[0] + 1]
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        for block in range(0, len(index.latent), ITEM_BLOCK):
            row, col = np.nonzero(z @ index.latent[block : block + ITEM_BLOCK].T >= near)
            near_passage.append(s + row)
            near_item.append(index.of[block + col])
    row, k = np.concatenate(near_passage), np.concatenate(near_item)
    can = _possible(index, of, passages[row], text[row], k)
    row, k = row[can], k[can]
    low, high, _ = _region(index, of, passages[row], text[row], k)
    for t, a, b, c in sorted(set(zip(text[row].tolist(), low.tolist(), high.tolist(), k.tolist(), strict=True))):
        share = _verified(index, of.codes[a:b], c)
        item = index.items[c][0]
        if share > found[t].get(item, 0.0):
            found[t][item] = share
    return found


def judged(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """docs with _b_items (items found, ascending) and _b_share (largest share, 0.0 if none).

    Null and empty texts hold no item; an empty benchmark finds none; null items and items without words are left out; every row comes back once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = shared.value
        trim()  # what the worker's earlier tasks, of other stages too, have freed
        for texts in batches:
            once = pc.fill_null(texts, "").dictionary_encode()  # equal texts are judged once
            kinds = pa.RecordBatch.from_arrays([once.dictionary], ["text"])
            found = [f for part in runs(iter([kinds]), 0, BATCH_BYTES) for f in judge(of, part.column(0).combine_chunks())]
            rows = [found[k] for k in once.indices.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([sorted(f) for f in rows], pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in rows], pa.float64())], ["items", "share"])
            del once, kinds
            trim()

    out = docs.withColumn("_b", F.arrow_udf(run, "items array<bigint>, share double")(F.col(text_col)))
    return out.withColumns({"_b_items": F.col("_b.items"), "_b_share": F.col("_b.share")}).drop("_b")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, in its columns, without the rows that hold an item."""
    return judged(docs, fitted(docs, benchmark)).where(F.size("_b_items") == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = judged(docs, fitted(docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", (F.size("_b_items") > 0).alias("contaminated"), F.col("_b_items").alias("items"), F.col("_b_share").alias("share"))
