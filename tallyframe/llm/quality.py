"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

1. A logistic model of ten shape features of the whole text gives each document its own evidence. It is fitted on at
   most FIT_ROWS labelled documents (those of least hash of id; a documented bound), on the driver.
2. Grouped aggregation over all documents gives each path (host and path) and each host its number of documents and the
   sum of their posteriors. Rates shrink: a path towards its host's rate, a host towards the global one, each as a Beta prior whose weight is estimated from the spread between
   groups (moments), so sparse sites keep near the prior. A document's own posterior is left out of the rates that it is judged by.
3. Posterior log-odds = the document's own log-odds + log-odds of its path's rate - log-odds of the global rate.

At scale: two small aggregations that combine before the shuffle. The stored table of sites meets documents by the join that Spark
picks for its size; a sort-merge join is split where a site is hot.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, least_hashed, stored, table

FIT_ROWS = 20_000
ACCEPT = 0.5
FEATURES = 10
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"*#%&$|<>{}~^=_+@\\"
_PLAIN = b".,;:?'\"()-"


def features(text: str | None) -> list[float]:
    """Shape of a text; zeros for null, empty and blank texts but the first, which marks them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    if not words:
        return [1.0] + [0.0] * (FEATURES - 1)
    n, size = len(words), len(raw)
    left = lambda cut: (size - len(raw.translate(None, cut))) / size
    return [
        0.0,
        np.log1p(n) / 10,
        left(_UPPER),
        left(_DIGIT),
        left(_SYMBOL),
        left(b"!"),
        left(_PLAIN),
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        min(1.0, size / n / 20),
    ]


def _features(text: Column) -> Column:
    def shapes(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return F.pandas_udf(shapes, "array<double>")(text)


def fit(shapes: np.ndarray, good: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's method on standardised features: rows of (weights, then bias)."""
    if len(good) == 0 or good.min() == good.max():
        rate = (good.sum() + 0.5) / (len(good) + 1)
        return np.append(np.zeros(2 * FEATURES), np.log(rate / (1 - rate)))
    x = np.hstack([shapes, np.sqrt(np.maximum(shapes, 0))])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(x) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (good - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _evidence(shape: Column, weights: np.ndarray) -> Column:
    out = F.lit(float(weights[-1]))
    for i in range(FEATURES):
        v = F.greatest(shape[i], F.lit(0.0))
        out = out + shape[i] * float(weights[i]) + F.sqrt(v) * float(weights[FEATURES + i])
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), out))


def _weight(groups: DataFrame, rate: str, prior: Column) -> float:
    """Weight of the Beta prior by moments: p(1-p) / spread between groups - 1, within 1 to 1000."""
    got = groups.where("n >= 2").agg(F.avg(F.pow(F.col(rate) - prior, 2) - F.col(rate) * (1 - F.col(rate)) / F.col("n")), F.avg(prior * (1 - prior))).first()
    if got[0] is None or got[0] <= 1e-9:
        return 1000.0
    return float(min(1000.0, max(1.0, got[1] / got[0] - 1)))


def model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights of the document classifier. Null ids, labels other than 0 and 1, and ids that have two labels are left out."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("_good"), F.max(label_col).alias("_most")).where("_good = _most")
    chosen = least_hashed(known.select(id_col, "_good", F.xxhash64(id_col).alias("_h")), "_h", fit_rows, [id_col]).drop("_h")
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(_features(F.col(text_col)).alias("shape"), F.col("_good").cast("double").alias("good")).toPandas()
    shapes = np.array(rows["shape"].tolist(), float).reshape(len(rows), FEATURES)
    return fit(shapes, rows["good"].to_numpy(float))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with doc_score, host_rate, path_rate, score (chance of quality 1) and keep (score >= 0.5), under those names with a leading _q_.

    host and path default to source and lang, the site and its section here; nulls form a site of their own. Every row of docs comes
    back once, repeated rows too. Without labels all scores are 0.5 and all is kept.
    """
    weights = model(docs, labels, fit_rows, id_col, text_col)
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))
    own = docs.withColumns({"_q_host": host, "_q_path": path, "_q_shape": _features(F.col(text_col))}).withColumn("_q_own", _evidence(F.col("_q_shape"), weights)).drop("_q_shape")
    chance = 1 / (1 + F.exp(-F.col("_q_own")))
    paths = stored(own.groupBy("_q_host", "_q_path").agg(F.count("*").alias("n"), F.sum(chance).alias("k")), "paths")
    hosts = paths.groupBy("_q_host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("k"), F.sum("n")).first()
    overall = ((total[0] or 0.0) + 0.5) / ((total[1] or 0) + 1)
    m_host = _weight(hosts.withColumn("rate", F.col("k") / F.col("n")), "rate", F.lit(overall))
    hosts = hosts.select("_q_host", F.col("n").alias("_q_hn"), F.col("k").alias("_q_hk"))
    sites = stored(paths.join(hosts, "_q_host").select("_q_host", "_q_path", "_q_hn", "_q_hk", F.col("n").alias("_q_n"), F.col("k").alias("_q_k")), "sites")
    m_path = _weight(sites.withColumns({"rate": F.col("_q_k") / F.col("_q_n"), "n": F.col("_q_n")}), "rate", (F.col("_q_hk") + m_host * overall) / (F.col("_q_hn") + m_host))
    out = own.join(sites, ["_q_host", "_q_path"]).withColumn("_q_doc_score", chance)
    others = lambda k, n, m, prior: (F.greatest(F.col(k) - F.col("_q_doc_score"), F.lit(0.0)) + m * prior) / (F.col(n) - 1 + m)
    out = out.withColumn("_q_host_rate", others("_q_hk", "_q_hn", m_host, F.lit(overall)))
    out = out.withColumn("_q_path_rate", others("_q_k", "_q_n", m_path, F.col("_q_host_rate"))).drop("_q_hn", "_q_hk", "_q_n", "_q_k")
    out = out.withColumn("_q_score", 1 / (1 + F.exp(-(F.col("_q_own") + logit(F.col("_q_path_rate")) - float(np.log(overall / (1 - overall)))))))
    return out.withColumn("_q_keep", F.col("_q_score") >= ACCEPT).drop("_q_own")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, in its columns, without the rows that the classifier rejects."""
    return judged(docs, labels).where("_q_keep").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), *[F.col(f"_q_{k}").alias(k) for k in ("doc_score", "host_rate", "path_rate", "score", "keep")])
