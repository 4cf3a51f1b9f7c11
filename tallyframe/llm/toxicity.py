"""Toxicity: a linear-chain conditional random field tags offending tokens of whole texts.

Tokens are runs without white space; their features are the word, its beginnings and its endings, hashed. Only documents have
labels, so tokens are labelled first: in toxic training documents those whose word or beginning occurs nearly only in toxic
training documents (counted by grouped aggregation over at most COUNT_DOCS a class, of which near copies that agree in their least
shingles count once) and in SUPPORT of the toxic ones at least, none in clean ones; after a first fit, the field's own
marginals in toxic documents add labels. A text is one chain: it is cut into blocks of WINDOW tokens, the blocks' transfer matrices carry the forward
and backward messages over the cuts, and so all blocks of all texts are worked on side by side. The fit counts moves within blocks only.
Forward-backward marginals give the tagged spans and, by a logistic map of the largest marginal and of their sum
(fitted on training documents), the document's score.

At scale: labels choose documents by a broadcast of their bounded ids, so texts are never shuffled; the field is fitted on the
driver on at most FIT_DOCS labelled documents a class of at most FIT_CHARS characters (those of least hash, as for COUNT_DOCS; documented bounds). All documents are scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, least_hashed, stored, table

FIT_DOCS = 2500
COUNT_DOCS = 20_000
FIT_CHARS = 20_000
SUPPORT = 0.002
WINDOW = 64
WEIGHTS = 1 << 18
_EDGE = ".,;:!?\"'()[]{}<>*#%&$|-_"


def plain(token: str) -> str:
    return token.lower().strip(_EDGE)


def keys(token: str) -> list[str]:
    """Names of a token's features."""
    w = plain(token)
    return ["w" + w, *["p" + w[:k] for k in (3, 4, 5, 6) if len(w) > k], *["s" + w[-k:] for k in (3, 4) if len(w) > k]]


def slots(token: str) -> list[int]:
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % WEIGHTS for k in keys(token)]


def least_shingle(text: str, words: int = 5) -> int:
    """Least hash of the word shingles of a text: near copies often agree in it."""
    import xxhash

    w = text.split()
    return min((xxhash.xxh64_intdigest(" ".join(w[k : k + words]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(w) - words + 1))), default=0) >> 1


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Where in a (windows, WINDOW) matrix each token of consecutive texts goes, and the number of windows."""
    count = -(-lengths // WINDOW)
    first = np.cumsum(count) - count
    begin = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(first * WINDOW - begin, lengths), int(count.sum())


def marginals(u: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over rows of u, the log-odds of label 1 against 0: chances of label 1, and expected moves (2, 2)."""
    n, width = u.shape
    gain = np.exp(np.clip(u, -30, 30))
    step = np.exp(move)
    ahead = np.empty((width, n, 2))
    back = np.empty((width, n, 2))
    now = np.stack([np.ones(n), gain[:, 0]], 1)
    ahead[0] = now / now.sum(1, keepdims=True)
    for t in range(1, width):
        now = ahead[t - 1] @ step
        now[:, 1] *= gain[:, t]
        ahead[t] = now / now.sum(1, keepdims=True)
    back[-1] = 1
    moved = np.zeros((2, 2))
    for t in range(width - 1, 0, -1):
        x = back[t].copy()
        x[:, 1] *= gain[:, t]
        joint = ahead[t - 1][:, :, None] * step[None] * x[:, None, :]
        moved += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        x = x @ step.T
        back[t - 1] = x / x.sum(1, keepdims=True)
    both = ahead * back
    return (both[:, :, 1] / both.sum(2)).T, moved


def chain_marginals(u: np.ndarray, real: np.ndarray, rank: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Chances of label 1 for blocks (rows of u) of whole chains: rank is a block's place in its chain, blocks of a chain stand one after another, real marks tokens
    (a chain's last block may have fewer). The same as forward-backward over each whole chain."""
    n, width = u.shape
    gain = np.exp(np.clip(u, -30, 30))
    step = np.exp(move)
    first = rank == 0
    ahead, now = np.empty((width, n, 2, 2)), np.broadcast_to(np.eye(2), (n, 2, 2))  # rows: which label the block before ended with
    for t in range(width):
        new = now @ step
        if t == 0:
            new[first] = 1.0  # a chain starts with either label
        new[:, :, 1] *= gain[:, t, None]
        new /= new.sum((1, 2), keepdims=True)
        now = np.where(real[:, t, None, None], new, now)
        ahead[t] = now
    behind, now = np.empty((width, n, 2, 2)), np.broadcast_to(np.eye(2), (n, 2, 2))  # columns: the message behind the block's last token
    for t in range(width - 1, -1, -1):
        behind[t] = now
        new = now.copy()
        new[:, 1] *= gain[:, t, None]
        new = step @ new
        new /= new.sum((1, 2), keepdims=True)
        now = np.where(real[:, t, None, None], new, now)
    before, after = np.full((n, 2), 0.5), np.full((n, 2), 0.5)
    order = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[order], np.arange(1, int(rank.max(initial=0)) + 2))
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[s:e]
        x = (before[k - 1, None] @ ahead[-1, k - 1])[:, 0]
        before[k] = x / x.sum(1, keepdims=True)
    for s, e in zip(cuts[:-1][::-1], cuts[1:][::-1], strict=True):
        k = order[s:e]
        x = (now[k] @ after[k, :, None])[:, :, 0]
        after[k - 1] = x / x.sum(1, keepdims=True)
    both = (before[None, :, None] @ ahead)[:, :, 0] * (behind @ after[None, :, :, None])[..., 0]
    return (both[:, :, 1] / both.sum(2)).T


class Field:
    def __init__(self) -> None:
        self.weights = np.zeros(WEIGHTS, np.float32)
        self.bias = -4.0
        self.move = np.zeros((2, 2))
        self.map = np.array([1.0, 0.0, 0.0])
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        at = np.flatnonzero(self.weights)
        return {"at": at, "w": self.weights[at], "bias": self.bias, "move": self.move, "map": self.map}

    def __setstate__(self, s: dict) -> None:
        self.__init__()
        self.weights[s["at"]] = s["w"]
        self.bias, self.move, self.map = s["bias"], s["move"], s["map"]

    def unary(self, token: str) -> float:
        x = self.known.get(token)
        if x is None:
            if len(self.known) > 400_000:
                self.known.clear()
            x = self.known[token] = self.bias + float(self.weights[slots(token)].sum())
        return x

    def tagged(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals of label 1 for each token of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        out: list[np.ndarray] = []
        cuts, begin, held = [0], 0, 0
        for i, n in enumerate(lengths):
            held += n
            if held > 400_000:
                cuts.append(i + 1)
                held = 0
        for begin, end in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            at, n = _windows(lengths[begin:end])
            if not n:
                out += [np.zeros(0)] * (end - begin)
                continue
            u, real = np.zeros(n * WINDOW), np.zeros(n * WINDOW, bool)
            unary = self.unary
            u[at] = [unary(w) for t in texts[begin:end] for w in t]
            real[at] = True
            blocks = -(-lengths[begin:end] // WINDOW)
            rank = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            m = chain_marginals(u.reshape(n, WINDOW), real.reshape(n, WINDOW), rank, self.move)
            out += np.split(m.ravel()[at], np.cumsum(lengths[begin:end])[:-1])
        return out

    def evidence(self, m: np.ndarray) -> list[float]:
        top = float(np.clip(m.max(), 1e-6, 1 - 1e-6)) if len(m) else 1e-6
        return [math.log(top / (1 - top)), math.log1p(float(m.sum())), 1.0]

    def score(self, m: np.ndarray) -> float:
        return 1 / (1 + math.exp(-float(np.clip(np.dot(self.map, self.evidence(m)), -30, 30))))

    def fit(self, texts: list[list[str]], marked: list[np.ndarray], epochs: int = 6, rate: float = 0.3, seed: int = 7) -> None:
        """AdaGrad on the conditional log-likelihood of the labels, over all windows with a label and three times as many without."""
        rows, width, pad = [], max((len(slots("abcdefghij")), 1)), WEIGHTS
        labels = []
        for t, y in zip(texts, marked, strict=True):
            for s in range(0, len(t), WINDOW):
                rows.append(t[s : s + WINDOW])
                labels.append(y[s : s + WINDOW])
        rng = np.random.default_rng(seed)
        hot = [i for i, y in enumerate(labels) if y.any()]
        cold = [i for i, y in enumerate(labels) if not y.any()]
        cold = [cold[i] for i in rng.permutation(len(cold))[: max(3 * len(hot), 200)]]
        chosen = np.array(hot + cold, np.int64)
        x = np.full((len(chosen), WINDOW, width), pad, np.int32)
        y = np.zeros((len(chosen), WINDOW))
        real = np.zeros((len(chosen), WINDOW), bool)
        known: dict[str, list[int]] = {}
        for k, i in enumerate(chosen):
            for j, w in enumerate(rows[i]):
                got = known.get(w) or known.setdefault(w, slots(w))
                x[k, j, : len(got)] = got
            y[k, : len(rows[i])] = labels[i]
            real[k, : len(rows[i])] = True
        w, square = np.zeros(WEIGHTS + 1), np.full(WEIGHTS + 1, 1e-3)
        move_square, bias_square = np.full((2, 2), 1e-3), 1e-3
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 256)):
                u = np.where(real[part], w[x[part]].sum(2) + self.bias, -30.0)
                m, moved = marginals(u, self.move)
                wrong = np.where(real[part], y[part] - m, 0.0) / len(part)
                g = np.bincount(x[part].ravel(), np.repeat(wrong.ravel(), width), WEIGHTS + 1) - 1e-6 * w
                g[pad] = 0
                square += g * g
                w += rate * g / np.sqrt(square)
                yy = y[part].astype(int)
                seen = np.bincount((yy[:, :-1] * 2 + yy[:, 1:]).ravel(), minlength=4).reshape(2, 2)
                gm = (seen - moved) / len(part)
                move_square += gm * gm
                self.move += 0.1 * gm / np.sqrt(move_square)
                self.move -= self.move[0, 0]
                gb = wrong.sum()
                bias_square += gb * gb
                self.bias += 0.1 * gb / np.sqrt(bias_square)
        self.weights = w[:WEIGHTS].astype(np.float32)
        self.known = {}

    def calibrate(self, found: list[np.ndarray], toxic: np.ndarray) -> None:
        z = np.array([self.evidence(m) for m in found]).reshape(-1, 3)
        prior = np.array([0.5, 0.5, math.log((toxic.mean() + 1e-3) / (1 - toxic.mean() + 1e-3))]) if len(toxic) else self.map
        w = prior.copy()
        for _ in range(50):
            if not len(toxic):
                break
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(3), z.T @ (toxic - p) - 0.5 * (w - prior))
        self.map = w


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, count_docs: int = COUNT_DOCS) -> Field:
    """Fit on labelled documents that are not held out. Null ids, null labels and ids labelled both ways are left out; of an id with several texts the least hash counts; without toxic labels nothing is tagged."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).alias("_toxic"), F.max(label_col).alias("_most")).where("_toxic = _most").drop("_most")
    ranked = known.withColumn("_h", F.xxhash64(id_col))
    texts_of = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))
    few = lambda n: F.broadcast(least_hashed(ranked.where("_toxic = 0"), "_h", n, [id_col]).unionAll(least_hashed(ranked.where("_toxic = 1"), "_h", n, [id_col])).drop("_h"))
    least = F.pandas_udf(lambda t: t.map(least_shingle), "bigint")
    rows = texts_of.join(few(count_docs), id_col).groupBy(least("_text").alias("_s"), "_toxic").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each word and each beginning of each text once, as counts of clean and toxic texts in this partition."""
        count: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b["_text"], b["_toxic"], strict=True):
                for k in {k for w in set(text.split()) for k in keys(w) if k[0] != "s"}:
                    count.setdefault(k, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame([(k, *v) for k, v in count.items()], columns=["k", "clean", "toxic"])

    rows = stored(rows.select("_text", "_toxic"), "toxicity-texts")  # bounded by count_docs a class
    offending = rows.where("_toxic = 1").count()
    counts = rows.mapInPandas(parts, "k string, clean long, toxic long").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon = {r["k"] for r in counts.where((F.col("toxic") >= max(3, math.ceil(SUPPORT * offending))) & F.expr("toxic >= 19 * clean")).collect()}  # 1 / SUPPORT times the words of a text at most
    one = F.min_by("_text", F.xxhash64("_text")).alias("_text")
    some = texts_of.where(F.length("_text") <= fit_chars).join(few(fit_docs), id_col).groupBy(id_col, "_toxic").agg(one).toPandas().sort_values(id_col)
    texts = [t.split() for t in some["_text"]]
    toxic = some["_toxic"].to_numpy(float)
    field = Field()
    if not toxic.any():
        field.map = np.array([0.0, 0.0, -6.0])
        return field
    named: dict[str, bool] = {}
    for t in texts:
        for w in t:
            if w not in named:
                named[w] = bool(lexicon.intersection(keys(w)))
    marked = [np.array([y and named[w] for w in t], bool) for t, y in zip(texts, toxic, strict=True)]
    field.fit(texts, marked)
    more = field.tagged(texts)
    marked = [a | (m > 0.5) if y else a for a, m, y in zip(marked, more, toxic, strict=True)]
    field.fit(texts, marked)
    field.calibrate(field.tagged(texts), toxic)
    return field


def scored(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with _t_score (chance of label 1) and _t_spans (offsets, in characters, of tagged runs of tokens).

    Null and empty texts have no spans and the score of a text without marks. Every row comes back once; other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re

        of = shared.value
        for series in texts:
            tokens = [(t or "").split() for t in series]
            scores, spans = [], []
            for text, m in zip(series, of.tagged(tokens), strict=True):
                scores.append(of.score(m))
                found: list[list[int]] = []
                if len(m) and m.max() > 0.5:
                    last = -2
                    for i, x in enumerate(re.finditer(r"\S+", text)):
                        if m[i] > 0.5:
                            if last == i - 1:
                                found[-1][1] = x.end()
                            else:
                                found.append([x.start(), x.end()])
                            last = i
                spans.append([f"{a}-{b}" for a, b in found])
            yield pd.DataFrame({"score": scores, "spans": spans})

    judged = F.pandas_udf(judge, "score double, spans array<string>")
    return docs.withColumn("_t", judged(F.col(text_col))).withColumns({"_t_score": F.col("_t.score"), "_t_spans": F.transform("_t.spans", lambda s: F.struct(F.split_part(s, F.lit("-"), F.lit(1)).cast("int").alias("begin"), F.split_part(s, F.lit("-"), F.lit(2)).cast("int").alias("end")))}).drop("_t")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_t_score").alias("score"), (F.col("_t_score") >= 0.5).cast("int").alias("predicted"), F.col("_t_spans").alias("spans"))
