"""Katz scores against a plain evaluation of the definition."""

import math
import random
import zlib
from collections import Counter

import pytest

from tallyframe.llm import katz


def brute(rows):
    tokens = lambda t: (t or "").encode().lower().split() + ["end"]
    uni, bi = Counter(), Counter()
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not out_of(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["start", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)

    def discount(c):
        of = Counter(c.values())
        d = katz.discounts([of[r] for r in range(1, katz.KATZ + 2)])
        return lambda r: d[r] if r <= katz.KATZ else katz.ABOVE

    d1, d2 = discount(uni), discount(bi)
    p1 = lambda w: d1(uni[w]) * uni[w] / n if uni[w] else 1 - sum(d1(c) * c / n for c in uni.values())
    total = Counter()
    for (a, _), c in bi.items():
        total[a] += c

    def p2(a, w):
        if bi[a, w]:
            return d2(bi[a, w]) * bi[a, w] / total[a]
        if not total[a]:
            return p1(w)
        seen = [x for x in uni if bi[a, x]]
        return p1(w) * (1 - sum(d2(bi[a, x]) * bi[a, x] / total[a] for x in seen)) / (1 - sum(p1(x) for x in seen))

    for a in list(total)[:5]:  # exactly normalised
        assert math.isclose(sum(p2(a, w) for w in [*uni, "never"]), 1, rel_tol=1e-9)
    found = []
    for i, t in rows:
        w = tokens(t)
        found.append((i, out_of(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(a, x)) for a, x in zip(["start", *w], w, strict=False))))
    return sorted(found, key=repr)


@pytest.mark.parametrize("heavy", [0.5, 0.02, 1e-9])
def test_scores_equal_the_definition(spark, heavy):
    r = random.Random(3)
    words = ["the", "of", "A", "bé", "x.", "q"] + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(r.choices(words, [40, 30, 20, 9, 9, 9] + [1] * 60, k=r.randint(0, 40)))) for k in range(120)]
    rows += [(7, rows[7][1]), (500, rows[3][1]), (501, None), (502, ""), (None, "the of\tthe\n"), (503, "  Never seen zzz  ")]
    got = katz.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), heavy=heavy, bucket_tokens=200)
    got = sorted((tuple(x) for x in got.collect()), key=repr)
    want = brute(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def test_equal_batches(spark):
    """Partitions of the same texts make equal batches; each counts, none is scored twice."""
    rows = [(k, "a b a c") for k in range(8)] + [(20 + k, "a b d") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(16, "doc_id")
    got = sorted(tuple(x) for x in katz.scored(docs, heavy=0.9, bucket_tokens=10).collect())
    want = sorted(brute(rows))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5:] for x in got] == [pytest.approx(x[5:], rel=1e-9) for x in want]


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, bucket int, kind string")
    assert katz.scored(none).collect() == []
    one = spark.createDataFrame([(1, "a b", 3, "k")], "doc_id bigint, text string, bucket int, kind string")
    assert katz.scored(one).count() == 1


@pytest.mark.parametrize("heavy", [0.5, 0.02])
def test_tables_score_any_texts_the_same(spark, heavy):
    r = random.Random(5)
    words = ["the", "of", "A", "x."] + [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(r.choices(words, [40, 30, 20, 9] + [1] * 40, k=r.randint(0, 30)))) for k in range(80)] + [(200, None), (201, "never seen the zzz the"), (202, "of " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out, tables = katz.scored_with_tables(docs, heavy=heavy, bucket_tokens=100)
    want = {x["doc_id"]: (x["n_tokens"], x["score"]) for x in out.collect()}
    got = {x["doc_id"]: (x["n_tokens"], x["score"]) for x in katz.evaluated(docs, tables).collect()}
    assert got.keys() == want.keys()
    for k, (n, score) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(score, rel=1e-9, abs=1e-9)
    assert katz.evaluated(docs.limit(0), tables).collect() == []
