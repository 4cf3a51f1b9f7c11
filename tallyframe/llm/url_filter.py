"""URL filter: longest fitting rule, else the ratio of two character language models.

Two variable-order Markov models over the characters of host and path are learned from the urls that the rules accept and
reject. A context of up to ORDER characters counts where it was seen at least twice in its class; each longer context
is smoothed towards the next shorter one (Witten-Bell), the shortest towards equal chances. A url's score is the difference
of its two log-likelihoods, divided by its length; it is allowed at or above a threshold calibrated on urls left out of
the counts (the middle between what best parts both classes, each class weighing the same).

At scale: the rules are Column expressions. The models are fitted on at most FIT_URLS distinct urls a class (those of
least hash: a documented bound) of any length, on the driver; what is broadcast is their contexts. All urls are judged in one pass
without a shuffle; repeated urls and hot hosts need no care.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, least_hashed, table

#: (host, path prefix, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
FIT_URLS = 10_000
ORDER = 5
ALPHABET = 256
_START, _END = "\x02", "\x03"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them; both empty for null and for no ://"""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def matched(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule (of host and path together; of equal ones the first) that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Markov:
    """Witten-Bell smoothed variable-order model of the characters of one class."""

    def __init__(self, texts: list[str], order: int = ORDER) -> None:
        self.order = order
        seen: Counter = Counter()
        for t in texts:
            t = _START * order + t + _END
            for i in range(order, len(t)):
                for k in range(order + 1):
                    seen[t[i - k : i + 1]] += 1
        total: Counter = Counter()
        kinds: Counter = Counter()
        for gram, n in seen.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        self.total = {c: n for c, n in total.items() if n >= 2 or not c}
        self.kinds = {c: kinds[c] for c in self.total}
        self.seen = {g: n for g, n in seen.items() if g[:-1] in self.total}

    def chance(self, gram: str) -> float:
        """Chance of the last character of gram after the others."""
        p = 1 / ALPHABET
        for k in range(len(gram) - 1, -1, -1):
            context = gram[k:-1]
            n = self.total.get(context)
            if n is None:
                break
            p = (self.seen.get(gram[k:], 0) + self.kinds[context] * p) / (n + self.kinds[context])
        return p


class Ratio:
    """Length-normalised difference of log-likelihoods under the accepted and rejected models; grams are scored once a process."""

    def __init__(self, good: list[str], bad: list[str], order: int = ORDER) -> None:
        held = lambda u: zlib.crc32(u.encode("utf-8", "surrogatepass")) % 4 == 0
        self.order = order
        self.good, self.bad = (Markov([u for u in us if not held(u)] or us, order) for us in (good, bad))
        self.known: dict[str, float] = {}
        scored = sorted([(self(u), True) for u in good if held(u)] + [(self(u), False) for u in bad if held(u)])
        n_good = sum(x for _, x in scored) or 1
        n_bad = (len(scored) - sum(x for _, x in scored)) or 1
        best, kept, self.threshold = -1.0, 1.0, 0.0
        for i, (score, is_good) in enumerate(scored):
            if kept > best and (i == 0 or scored[i - 1][0] < score):
                best, self.threshold = kept, (score + scored[i - 1][0]) / 2 if i else score - 1e-9
            kept += -1 / n_good if is_good else 1 / n_bad
        self.known = {}

    def __call__(self, text: str) -> float:
        t, out = _START * self.order + text + _END, 0.0
        for i in range(self.order, len(t)):
            gram = t[i - self.order : i + 1]
            x = self.known.get(gram)
            if x is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                x = self.known[gram] = math.log(self.good.chance(gram) / self.bad.chance(gram))
            out += x
        return out / (len(text) + 1)


def fit(urls: DataFrame, url_col: str = "url", rules: tuple = RULES, fit_urls: int = FIT_URLS) -> Ratio:
    """Learn from the urls that rules decide, at most fit_urls distinct ones a class; urls without labels give a score of 0 and a threshold of 0.

    Repeated urls count once; of urls of one hash the lesser come first; whole urls are learned, however long.
    """
    host, path = split_url(F.col(url_col))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    decided = urls.select(host.alias("host"), path.alias("path")).select(F.concat("host", "path").alias("u"), verdict.alias("v")).where("v is not null").distinct().withColumn("h", F.xxhash64("u"))
    chosen = {v: [r[0] for r in least_hashed(decided.where(F.col("v") == v), "h", fit_urls, ["u"]).select("u").orderBy("u").collect()] for v in ("allow", "block")}
    return Ratio(chosen["allow"], chosen["block"])


def judged(urls: DataFrame, url_col: str = "url", rules: tuple = RULES, model: Ratio | None = None) -> DataFrame:
    """urls with host, path, rule, verdict and score (null where a rule decides) as _u_ columns; every row comes back once.

    Null urls and such without :// have empty host and path; they and all that no rule fits are judged by the models. An empty table gives no rows.
    """
    model = model or fit(urls, url_col, rules)
    spark = urls.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value
        for t in texts:
            yield t.map(lambda x: None if x is None else of(x)).astype("float64")

    scored = F.pandas_udf(scores, "double")
    host, path = split_url(F.col(url_col))
    rule, verdict = matched(F.col("_u_host"), F.col("_u_path"), rules)
    out = urls.withColumns({"_u_host": host, "_u_path": path}).withColumns({"_u_rule": rule, "_u_by_rule": verdict})
    out = out.withColumn("_u_score", scored(F.when(F.col("_u_by_rule").isNull(), F.concat("_u_host", "_u_path"))))
    own = F.when(F.col("_u_score") >= model.threshold, "allow").otherwise("block")
    return out.withColumn("_u_verdict", F.coalesce("_u_by_rule", own)).drop("_u_by_rule")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "pages"))
    return out.select("page_id", *[F.col(f"_u_{k}").alias(k) for k in ("host", "path", "rule", "verdict", "score")])
