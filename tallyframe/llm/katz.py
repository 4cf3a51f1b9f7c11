"""Language-model scoring: a Katz backoff bigram model over the words of whole texts.

Tokens: words [^ \\t-\\r]+ of the text in lower case (A-Z), then one end; the first token's context is a start sign.
P(w|v) = d c(vw)/c(v) where the pair was seen, else alpha(v) P(w); P(w) = d c(w)/N where the word was seen, else what is left
as the chance of the one unknown token. d is the Good-Turing discount for counts up to KATZ (from the counts of counts of all training
texts) and ABOVE beyond, so every context keeps mass to back off with; alpha normalises each context exactly.

Tables (Parquet, partitioned by kind, in buckets of contexts or words): unigrams, pair counts (m, and h for pairs of two heavy words), backoff weights (b).
evaluated() scores any texts from these tables, token by token; scored() scores the texts of the corpus itself, where their pairs are counted anyway, and gives
the same (tested).
Words are named by 64-bit XXH64 (two words of a million share one once in 10^7 vocabularies), contexts by 48 bits of it.

At scale: all occurrences of a pair meet once, packed by (batch of texts, bucket), and are counted and scored where they meet;
what goes back to a text is a few sums, so occurrences are never joined with a table row by row. A light word (below
HEAVY of all tokens) decides the bucket of its pairs; there are at most 1/HEAVY + 2 heavy words, and pairs of two heavy ones are counted
as a bounded table and scored where the texts are. So no bucket gets more than HEAVY of all tokens from one key.
Equal texts of a batch are scored once. Texts are read three times; a source that gives other rows on another reading stops the job.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release, stored
from .packing import pack, unpack

KATZ, ABOVE = 5, 0.999
HEAVY = 1e-3
BATCH_CHARS, BATCH_ROWS = 14_000_000, 60_000
BUCKET_TOKENS = 3_000_000
#: Contexts go by 48 bits of their word's hash, which is what a pair costs to move; sums of logarithms go in units of 1e-10.
CONTEXT = (1 << 48) - 1
UNIT = 1e-10
ROW = "kind string, bucket int, batch bigint, blob binary"


def word_hash(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


START, END = b" <s>", b" </s>"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def _rows(*rows: tuple) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "bucket", "batch", "blob"])


def fixed(x: np.ndarray) -> np.ndarray:
    return -np.rint(x / UNIT).astype(np.int64)  # sums of logarithms are mostly below 0, and small numbers pack well


class Batch:
    """Distinct texts of some rows as codes: tokens (code of each, ends included), text of each, word hashes, training copies."""

    def __init__(self, rows: list[tuple]) -> None:
        import xxhash

        words: defaultdict = defaultdict(count().__next__)
        words[END]
        place: dict[str, int] = {}
        self.ids, self.held, self.at = [], [], []
        copies, codes = [], []
        for i, text, held in rows:
            k = place.get(text)
            if k is None:
                k = place[text] = len(codes)
                codes.append(np.array(list(map(words.__getitem__, text.encode("utf-8", "surrogatepass").lower().split())) + [0], np.int32))
                copies.append(0)
            copies[k] += not held
            self.ids.append(i)
            self.held.append(held)
            self.at.append(k)
        self.n = np.fromiter(map(len, codes), np.int64, len(codes))
        self.token = np.concatenate(codes)
        self.text = np.repeat(np.arange(len(codes), dtype=np.int32), self.n)
        self.copies = np.array(copies, np.int64)
        self.words = np.fromiter(map(word_hash, words), np.int64, len(words))
        first = np.cumsum(self.n) - self.n
        self.context = np.roll(self.token, 1)
        self.context[first] = -1  # the start sign
        h = hashlib.blake2b(digest_size=8)
        for t, c in zip(place, copies, strict=True):
            h.update(xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass")) + c.to_bytes(4, "little"))
        self.key = int.from_bytes(h.digest(), "little", signed=True)


def _batches(source: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    held, size = [], 0
    for whole in source:
        for b in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(r)
                size += len(r[1])
                if size >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                    full, held, size = Batch(held), [], 0  # rows go before the batch is worked on
                    yield full
                    del full
    if held:
        full, held = Batch(held), []
        yield full


def _words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _batches(source):
        n = np.bincount(b.token, b.copies[b.text], len(b.words)).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(b.words[at]), pa.array(n[at])], ["h", "c"])


def discounts(of: list[int]) -> list[float]:
    """d for counts 0 (unused) to KATZ, from the numbers of kinds with counts 1 to KATZ + 1; out of (0, 1), the discount is ABOVE."""
    n = [0, *of]
    out = [1.0] + [ABOVE] * KATZ
    if n[1]:
        common = (KATZ + 1) * n[KATZ + 1] / n[1]
        for r in range(1, KATZ + 1):
            if n[r] and common < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                out[r] = d if 0 < d < 1 else ABOVE
    return out


class Model:
    """What is known of words before pairs are counted: totals, discounts, heavy words; bounded by 1/HEAVY + 2."""

    def __init__(self, total: int, kinds: int, of: list[int], heavy: dict[int, int]) -> None:
        self.total, self.kinds, self.d1 = total, kinds, np.array([*discounts(of), ABOVE])
        left = sum(r * n * (1 - self.d1[r]) for r, n in enumerate([0, *of[:KATZ]]))
        above = total - sum(r * n for r, n in enumerate([0, *of[:KATZ]]))
        self.unknown = (left + above * (1 - ABOVE)) / total if total else 1.0
        self.start, self.end = word_hash(START), word_hash(END)
        heavy = heavy | {self.start: heavy.get(self.end, 0), self.end: heavy.get(self.end, 0)}
        self.heavy = np.array(sorted(heavy), np.int64)
        self.count = np.array([heavy[h] for h in self.heavy.tolist()], np.int64)
        self.start_at = int(np.searchsorted(self.heavy, self.start))

    def index(self, words: np.ndarray) -> np.ndarray:
        """Place among the heavy words, or -1."""
        at = np.minimum(np.searchsorted(self.heavy, words), len(self.heavy) - 1)
        return np.where(self.heavy[at] == words, at, -1)

    def context_index(self, contexts: np.ndarray) -> np.ndarray:
        """Place among the heavy words of contexts that are heavy."""
        short = self.heavy & CONTEXT
        order = np.argsort(short)
        return order[np.searchsorted(short[order], contexts)]

    def chance(self, c: np.ndarray) -> np.ndarray:
        """P of words by their counts."""
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.d1[np.minimum(c, KATZ + 1)] * c / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.kinds + 1))


def _pairs(shared, buckets: int) -> Callable:
    """Occurrences of pairs with a light word, packed by bucket, and counts of heavy pairs."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.heavy)
        for b in _batches(source):
            place = model.index(b.words)
            h2 = place[b.token]
            h1 = np.where(b.context < 0, model.start_at, place[b.context])  # place is int64, as its products need
            both = (h1 >= 0) & (h2 >= 0)
            n = np.bincount(h1[both] * k + h2[both], b.copies[b.text[both]]).astype(np.int64)
            at = np.flatnonzero(n)
            for s in np.unique(at % buckets).tolist():
                own = at[at % buckets == s]
                yield _rows(("h", -1 - s, b.key, pack(own, n[own])))
            light = np.flatnonzero(~both)
            words, texts = len(b.words) + 1, len(b.n)
            del h1, h2, both
            of2, of1 = b.words % buckets, (np.append(b.words, model.start) & CONTEXT) % buckets  # the context -1 is the last entry
            bucket = np.where(place[b.token[light]] < 0, of2[b.token[light]], of1[b.context[light]]).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
            light, ends = light[np.argsort(bucket, kind="stable")], np.cumsum(np.bincount(bucket, minlength=buckets))
            for own, part in enumerate(np.split(light, ends[:-1])):
                if len(part):
                    key = (b.token[part].astype(np.int64) * words + b.context[part] + 1) * texts + b.text[part]
                    key, n = np.unique(key, return_counts=True)
                    text, pair = (key % texts).astype(np.uint16), key // texts
                    new = np.flatnonzero(np.diff(pair, prepend=-1))
                    c2, c1 = pair[new] // words, pair[new] % words - 1
                    run2 = np.flatnonzero(np.diff(c2, prepend=-1))
                    a1 = np.where(c1 < 0, model.start, b.words[c1]) & CONTEXT
                    blob = pack(b.words[c2[run2]], np.diff(run2, append=len(c2)).astype(np.uint32), a1, np.diff(new, append=len(key)).astype(np.uint32), text, n.astype(np.uint32), b.copies.astype(np.uint32))
                    yield _rows(("o", own, b.key, blob))

    return run


def _met(shared, buckets: int) -> Callable:
    """All occurrences of a bucket's pairs: counts, sums for texts, sums for contexts, unseen pairs."""

    def run(rows: pa.Table) -> pa.Table:
        model, out = shared.value, []
        bucket = rows.column("bucket")[0].as_py()
        keys, raw = rows.column("batch").to_pylist(), rows.column("blob").to_pylist()
        times: Counter = Counter(keys)  # equal batches have one key: their texts are scored once and counted each time
        if bucket >= 0:
            keys, raw = list(times), list(dict(zip(keys, raw, strict=True)).values())
        blobs = [unpack(x) for x in raw]
        if bucket < 0:
            pair, back = np.unique(np.concatenate([x[0] for x in blobs]), return_inverse=True)
            return pa.Table.from_batches([_rows(("h", bucket, 0, pack(pair, np.bincount(back, np.concatenate([x[1] for x in blobs])).astype(np.int64))))])
        del raw
        w2 = np.concatenate([np.repeat(x[0], x[1]) for x in blobs])
        w1 = np.concatenate([x[2] for x in blobs])
        spans = np.concatenate([x[3] for x in blobs])
        n = np.concatenate([x[5] for x in blobs])
        trained = np.concatenate([x[5] * (x[6][x[4]].astype(np.float64) * times[k]) for x, k in zip(blobs, keys, strict=True)])
        text = np.concatenate([x[4] for x in blobs])
        rows_at = np.cumsum([0, *(len(x[4]) for x in blobs)])
        del blobs
        order = np.lexsort((w1, w2))
        w2, w1 = w2[order], w1[order]
        new2 = np.diff(w2, prepend=w2[:1] + 1) != 0
        new = new2 | (np.diff(w1, prepend=w1[:1] + 1) != 0)
        pair = np.empty(len(order), np.int32)
        pair[order] = np.cumsum(new) - 1
        p1, p2, u2 = w1[new], w2[new], w2[new2]
        word = (np.cumsum(new2) - 1)[new]  # of each pair
        del w1, w2, order, new, new2
        pair = np.repeat(pair, spans)
        del spans
        # what is as long as all occurrences is kept in few bytes; logarithms are taken once a pair
        seen = np.bincount(pair, trained, len(p1)).astype(np.int64)
        del trained
        own = np.bincount(word, seen, len(u2)).astype(np.int64)
        heavy = model.index(u2)
        own = np.where(heavy < 0, own, model.count[heavy])  # a heavy word's count is not in one bucket
        light = (heavy < 0)[word]
        c2 = own[word]
        chance = model.chance(own)
        out.append(("r", bucket, 0, pack(np.bincount(np.minimum(seen, KATZ + 2), minlength=KATZ + 3)[1 : KATZ + 2].astype(np.int64))))
        back, docs, ends = np.empty(len(text), np.int32), [], [0]
        for a, z in zip(rows_at[:-1], rows_at[1:], strict=True):
            own_texts, at = np.unique(text[a:z], return_inverse=True)
            back[a:z] = at + ends[-1]
            docs.append(own_texts)
            ends.append(ends[-1] + len(own_texts))
        total = lambda x: np.bincount(back, n * x[pair], ends[-1])
        hist = [total(seen == r).astype(np.uint32) for r in range(1, KATZ + 1)] + [total(seen > KATZ).astype(np.uint32)]
        known = light & (c2 > 0)
        katz = total(np.log10(np.maximum(seen, 1))) - total(np.where(known, np.log10(np.maximum(c2, 1)), 0.0)) + total(np.where(seen == 0, np.log10(chance)[word], 0.0))
        base = total(np.where(light, model.base(c2), 0.0))
        known = total(known).astype(np.uint32)
        for i, key in enumerate(keys):
            s = slice(ends[i], ends[i + 1])
            out.append(("d", bucket, key, pack(docs[i], *[h[s] for h in hist], fixed(katz[s]), fixed(base[s]), known[s])))
        del back
        at = np.flatnonzero(seen)
        runs = np.flatnonzero(np.diff(np.searchsorted(u2, p2[at]), prepend=-1))
        out.append(("m", bucket, 0, pack(p2[at][runs], np.diff(runs, append=len(at)).astype(np.uint32), p1[at], seen[at])))
        s1, back = np.unique(p1[at], return_inverse=True)
        sums = [np.bincount(back, seen[at] == r, len(s1)).astype(np.uint32) for r in range(1, KATZ + 1)]
        sums += [np.bincount(back, np.where(seen[at] > KATZ, seen[at], 0), len(s1)).astype(np.int64), np.bincount(back, chance[np.searchsorted(u2, p2[at])], len(s1))]
        for k in np.unique(s1 % buckets).tolist():
            m = s1 % buckets == k
            out.append(("c", k, 0, pack(s1[m], *[x[m] for x in sums])))
        at = np.flatnonzero((seen == 0)[pair])
        first, cut = p1[pair[at]], np.searchsorted(at, rows_at)
        for i, key in enumerate(keys):
            own_at, own_first = at[cut[i] : cut[i + 1]], first[cut[i] : cut[i + 1]]
            for k in np.unique(own_first % buckets).tolist():
                m = own_first % buckets == k
                out.append(("u", k, key, pack(own_first[m], text[own_at][m].astype(np.uint16), n[own_at][m].astype(np.uint32))))
        return pa.Table.from_batches([_rows(*out)])

    return run


def _backed(d: np.ndarray, extra: dict[int, np.ndarray], heavy: np.ndarray, buckets: int) -> Callable:
    """A bucket's contexts: exact backoff weights; and what unseen pairs add to their texts."""

    def run(rows: pa.Table) -> pa.Table:
        kinds, keys = rows.column("kind").to_pylist(), rows.column("batch").to_pylist()
        blobs = [unpack(x) for x in rows.column("blob").to_pylist()]
        bucket = rows.column("bucket")[0].as_py()
        of = [b for b, k in zip(blobs, kinds, strict=True) if k == "c"]
        own = {w: x for w, x in extra.items() if w % buckets == bucket}
        w = np.concatenate([np.zeros(0, np.int64), *[b[0] for b in of], np.array(list(own), np.int64)])
        x = np.concatenate([np.zeros((0, KATZ + 2)), *[np.stack(b[1:], 1).astype(float) for b in of], np.array(list(own.values())).reshape(-1, KATZ + 2)])
        w, back = np.unique(w, return_inverse=True)
        x = np.stack([np.bincount(back, x[:, i], len(w)) for i in range(KATZ + 2)], 1)
        r = np.arange(1, KATZ + 1)
        c = (x[:, :KATZ] * r).sum(1) + x[:, KATZ]
        kept = ((x[:, :KATZ] * r * d[1 : KATZ + 1]).sum(1) + ABOVE * x[:, KATZ]) / np.maximum(c, 1)
        alpha = (1 - kept) / (1 - x[:, KATZ + 1])
        out = [("b", bucket, 0, pack(w, c.astype(np.int64), alpha))]
        m = np.isin(w, heavy)
        if m.any():
            out.append(("a", bucket, 0, pack(w[m], c[m].astype(np.int64), alpha[m])))
        add = np.log10(alpha) + np.log10(np.maximum(c, 1))
        for b, k, key in zip(blobs, kinds, keys, strict=True):
            if k == "u":
                at = np.minimum(np.searchsorted(w, b[0]), max(0, len(w) - 1))
                value = np.where(w[at] == b[0], add[at], 0.0) * b[2] if len(w) else np.zeros(len(b[0]))
                text, back = np.unique(b[1], return_inverse=True)
                out.append(("x", bucket, key, pack(text, np.bincount(back, value, len(text)))))
        return pa.Table.from_batches([_rows(*out)])

    return run


def _texts(shared) -> Callable:
    """Rows of texts with what their heavy tokens and heavy pairs add."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, d, pair, seen, alpha = shared.value
        k = len(model.heavy)
        start = np.log10(max(1, int(model.count[model.start_at])))
        for b in _batches(source):
            place = model.index(b.words)
            h2 = place[b.token]
            h1 = np.where(b.context < 0, model.start_at, place[b.context])
            heavy = h2 >= 0
            c2 = model.count[np.maximum(h2, 0)]
            total = lambda x: np.bincount(b.text, x, len(b.n))  # noqa: B023, E731
            base = total(np.where(heavy, model.base(c2), 0.0))
            known = total(heavy & (c2 > 0)).astype(np.int64)
            context = heavy & (b.words[b.token] != model.end) & (c2 > 0)
            katz = -start - total(np.where(context, np.log10(np.maximum(c2, 1)), 0.0))
            both = np.flatnonzero(heavy & (h1 >= 0))
            key = h1[both] * k + h2[both]
            at = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            c = np.where(pair[at] == key, seen[at], 0) if len(pair) else np.zeros(len(key), np.int64)
            c1 = model.count[h1[both]]
            value = np.where(c > 0, np.log10(d[np.minimum(c, KATZ + 1)]) + np.log10(np.maximum(c, 1)), np.log10(model.chance(c2[both])) + np.where(c1 > 0, alpha[h1[both]] + np.log10(np.maximum(c1, 1)), 0.0))
            katz = katz + np.bincount(b.text[both], value, len(b.n))
            at = np.array(b.at, np.int64)
            values = [np.full(len(at), b.key), at, None, b.held, b.n[at], known[at], base[at], katz[at]]
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()) if v is None else pa.array(v) for v in values], ["batch", "text", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


TEXTS = "batch bigint, text bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _summed(d: np.ndarray) -> Callable:
    def run(texts: pa.Table, parts: pa.Table) -> pa.Table:
        at = texts.column("text").to_numpy()
        if not len(at):
            raise ValueError("a batch and its sums differ: the source gave other rows when it was read again")
        size = int(at.max()) + 1
        katz, base, known, met = np.zeros(size), np.zeros(size), np.zeros(size, np.int64), texts.column("n_tokens").to_numpy()
        logs = np.log10(d[1:])
        for kind, blob in zip(parts.column("kind").to_pylist(), parts.column("blob").to_pylist(), strict=True):
            x = unpack(blob)
            if kind == "x":
                np.add.at(katz, x[0], x[1])
                continue
            np.add.at(katz, x[0], sum(h * v for h, v in zip(x[1 : KATZ + 2], logs, strict=True)) - x[KATZ + 2] * UNIT)
            np.add.at(base, x[0], -x[KATZ + 3] * UNIT)
            np.add.at(known, x[0], x[KATZ + 4].astype(np.int64))
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(met), "n_known": pa.array(texts.column("n_known").to_numpy() + known[at]), "base_score": pa.array(texts.column("base_score").to_numpy() + base[at]), "score": pa.array(texts.column("score").to_numpy() + katz[at])})

    return run


@dataclass
class Tables:
    """A fitted model: unigrams (h, c), packed pair counts and backoff weights by kind, discounts of pairs, and what is known of all words."""

    words: DataFrame
    pairs: DataFrame
    backed: DataFrame
    model: Model
    d: np.ndarray

    def pair_counts(self) -> DataFrame:
        """(v, w, c): counts of pairs by 48 bits of the first word's hash and the second word's hash."""
        heavy, k = self.model.heavy, len(self.model.heavy)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = unpack(blob)
                    v, w, c = (x[2], np.repeat(x[0], x[1]), x[3]) if kind == "m" else (heavy[x[0] // k] & CONTEXT, heavy[x[0] % k], x[1])
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(w, pa.int64()), pa.array(c.astype(np.int64))], ["v", "w", "c"])

        return self.pairs.where("kind in ('m', 'h')").select("kind", "blob").mapInArrow(run, "v bigint, w bigint, c bigint")

    def contexts(self) -> DataFrame:
        """(v, n, alpha): tokens behind each context and its backoff weight."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blob in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(blob)], ["v", "n", "alpha"])

        return self.backed.where("kind = 'b'").select("blob").mapInArrow(run, "v bigint, n bigint, alpha double")


def evaluated(texts: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) of any texts by the stored tables: a pair's discounted share of its context where the pair is known, else the context's backoff weight (1 for
    an unknown context) times the word's own chance, which is its discounted share or, for an unknown word, that of the unknown token.

    Null and empty texts are one end token; rows are told apart by id, repeated ids add up. Tokens meet the tables by three joins, of which Spark splits hot keys.
    """
    model, d = tables.model, tables.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.array([*map(word_hash, (text or "").encode("utf-8", "surrogatepass").lower().split()), model.end], np.int64)
                v = np.append(model.start, w[:-1]) & CONTEXT
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(w), pa.int64()), pa.array(v, pa.int64()), pa.array(w)], ["id", "v", "w"])

    def share(c: Column, discount: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(float(x)) for x in discount]), (F.least(c, F.lit(KATZ + 1)) + 1).cast("int"))

    tokens = texts.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, v bigint, w bigint").groupBy("id", "v", "w").agg(F.count("*").alias("n"))
    words = tables.words.select(F.col("h").alias("w"), F.col("c").alias("cw"))
    met = tokens.join(tables.pair_counts(), ["v", "w"], "left").join(tables.contexts().select("v", F.col("n").alias("cv"), "alpha"), "v", "left").join(words, "w", "left")
    own = F.when(F.col("cw") > 0, share(F.col("cw"), model.d1) * F.col("cw") / max(1, model.total)).otherwise(float(model.unknown)) if model.total else F.lit(1.0)
    chance = F.when(F.col("c") > 0, share(F.col("c"), d) * F.col("c") / F.col("cv")).otherwise(F.coalesce("alpha", F.lit(1.0)) * own)
    return met.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.log10(chance)).alias("score")).withColumnRenamed("id", id_col)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, heavy: float = HEAVY, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 chances of the text) for each row of docs.

    Learns from the rows that are not held out (by default those whose crc32 of the id is not 2 modulo 7; null ids are learned from).
    Null and empty texts are one end token. Repeated rows count and come back each time; an empty table gives no rows; other columns are ignored.
    Without training rows every token is the unknown one, with chance 1.
    """
    return scored_with_tables(docs, id_col, text_col, held, heavy, bucket_tokens)[0]


def scored_with_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, heavy: float = HEAVY, bucket_tokens: int = BUCKET_TOKENS) -> tuple[DataFrame, Tables]:
    """What scored() gives, and the model's tables."""
    spark = docs.sparkSession
    held = held_out(F.col(id_col)) if held is None else held
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held"))
    words = stored(rows.mapInArrow(_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "unigrams")
    release(spark)
    counts = words.agg(F.sum("c"), F.count("*"), *[F.count_if(F.col("c") == r) for r in range(1, KATZ + 2)]).first()
    total = counts[0] or 0
    frequent = {r[0]: r[1] for r in words.where((F.col("c") >= heavy * total) | (F.col("h") == word_hash(END))).collect()}  # at most 1/heavy + 1
    model = Model(total, counts[1], list(counts[2:]), frequent)
    buckets = max(8, math.ceil(total / bucket_tokens))
    shared = spark.sparkContext.broadcast(model)
    met = rows.mapInArrow(_pairs(shared, buckets), ROW).groupBy("bucket").applyInArrow(_met(shared, buckets), ROW)
    table = stored(met, "pairs", partitioned="kind")
    release(spark)
    of = lambda kind: table.where(F.col("kind") == kind)
    n = np.zeros(KATZ + 1, np.int64)
    for r in of("r").select("blob").toLocalIterator():
        n += unpack(bytes(r[0]))[0]
    heavy_pairs = [unpack(bytes(r[0])) for r in of("h").select("blob").collect()]  # at most len(model.heavy) ** 2 counts
    pair = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in heavy_pairs]])
    seen = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in heavy_pairs]])
    order = np.argsort(pair)
    pair, seen = pair[order], seen[order]
    n += np.bincount(np.minimum(seen, KATZ + 2), minlength=KATZ + 3)[1 : KATZ + 2]
    d = np.array([*discounts(n.tolist()), ABOVE])
    k = len(model.heavy)
    extra: dict[int, np.ndarray] = {}
    chance = model.chance(model.count)
    for i in np.unique(pair // k).tolist():
        c = seen[pair // k == i]
        extra[int(model.heavy[i]) & CONTEXT] = np.array([*[(c == r).sum() for r in range(1, KATZ + 1)], c[c > KATZ].sum(), chance[pair[pair // k == i] % k].sum()], float)
    seeds = spark.createDataFrame([("c", i, 0, pack(np.zeros(0, np.int64), *[np.zeros(0, np.uint32)] * KATZ, np.zeros(0, np.int64), np.zeros(0))) for i in range(buckets)], ROW)
    backed = stored(of("c").unionByName(of("u")).select("kind", "bucket", "batch", "blob").unionByName(seeds).groupBy("bucket").applyInArrow(_backed(d, extra, model.heavy & CONTEXT, buckets), ROW), "backoff", partitioned="kind")
    alpha = np.zeros(k)
    for r in backed.where("kind = 'a'").select("blob").collect():  # heavy contexts only
        w, _, a = unpack(bytes(r[0]))
        alpha[model.context_index(w)] = np.log10(a)
    parts = of("d").select("kind", "batch", "blob").unionByName(backed.where("kind = 'x'").select("kind", "batch", "blob"))
    texts = rows.mapInArrow(_texts(spark.sparkContext.broadcast((model, d, pair, seen, alpha))), TEXTS)
    out = texts.groupBy("batch").cogroup(parts.groupBy("batch")).applyInArrow(_summed(d), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    out = out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
    return out, Tables(words, table, backed, model, d)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
