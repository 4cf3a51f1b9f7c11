"""Large benchmarks and words joined by marks lose no item."""

import random

import numpy as np

from tallyframe.llm import decontaminate

r = random.Random(31)


def prose(n):
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


def test_words_joined_by_marks_are_words():
    assert decontaminate.words_of("One-two/three, (four)_five=six") == ["one", "two", "three", "four", "five", "six"]


def test_items_joined_by_marks_are_found(spark):
    items = [(k, prose(30)) for k in range(20)]
    docs = spark.createDataFrame([(k, f"{prose(40)} {t.replace(' ', mark)} {prose(40)}") for k, t in items for mark in ("-", ",", "/")], "doc_id bigint, text string")
    found = decontaminate.judged(docs, decontaminate.fitted(docs, spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    assert all(x["_b_items"] == [x["doc_id"]] for x in found)


def test_directions_span_a_large_benchmark(spark):
    items = [(k, prose(40)) for k in range(400)]
    index = decontaminate.Index(items)
    axes = decontaminate.directions(spark.createDataFrame(items, "item_id bigint, text string"), spark.sparkContext.broadcast(index), index)
    found = index.rows([t for _, t in items])
    rows = np.zeros((len(found), index.terms))
    for k, (_, term, v) in enumerate(found):
        rows[k, term] = v
    assert np.abs(rows @ axes @ axes.T - rows).max() < 1e-3


def exhaustive(items, text):
    """Items whose words stand in any place of the text by the rule that the operator verifies candidates with, without a search."""
    words, found = decontaminate.words_of(text), set()
    for i, t in items:
        item = decontaminate.words_of(t)
        m, reach = len(item), len(item) + len(item) // 4
        for s in range(max(1, len(words) - m // 2)):
            place = words[s : s + reach]
            if len(set(item) & set(place)) >= 0.3 * m and decontaminate.common_length(item, place) >= decontaminate.SURE * m:
                found.add(i)
                break
    return found


def test_recall_against_exhaustive_search(spark):
    """Items of 5 to 59 words with up to 28 of 100 words replaced by words of the texts, in texts of all lengths."""
    items = [(k, " ".join([prose(r.randint(3, 57)), "the of"])) for k in range(120)] + [(500, "the of and to the of and in")]
    rows = []
    for k in range(360):
        words = items[k % 120][1].split()
        for j in range(len(words)):
            if r.random() < (0, 0.1, 0.28)[k % 3]:
                words[j] = f"w{r.randrange(4000)}"
        around = [" ".join(w if r.random() < 0.6 else r.choice(["the", "of", "and"]) for w in prose(r.randint(0, 200)).split()) for _ in range(2)]
        rows.append((k, f"{around[0]} {' '.join(words)} {around[1]}"))
    rows += [(1000 + k, prose(r.randint(1, 150))) for k in range(60)] + [(2000, "x y " + items[-1][1] + " z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: set(x["_b_items"]) for x in decontaminate.judged(docs, decontaminate.fitted(docs, spark.createDataFrame(items, "item_id bigint, text string"))).collect()}
    want = {i: exhaustive(items, t) for i, t in rows}
    pairs = [(i, k) for i, ks in want.items() for k in ks]
    assert len(pairs) > 300
    assert sum(k in got[i] for i, k in pairs if k < 500) >= 0.98 * sum(k < 500 for _, k in pairs)
    assert 500 in got[2000]  # an item of common words only
    assert not any(got[i] for i in got if 1000 <= i < 2000 and not want[i])


def test_batches_of_any_size_give_the_same(monkeypatch):
    import pyarrow as pa

    items = [(k, prose(40)) for k in range(30)]
    index = decontaminate.Index(items)
    index.axes = np.eye(index.terms, dtype=np.float32)
    decontaminate.finished(index)
    texts = [f"{prose(r.randint(0, 300))} {items[k % 30][1]} {prose(r.randint(0, 300))}" for k in range(60)] + [None, "", "w1", "w1 " * 40_000]
    want = decontaminate.judge(index, pa.array(texts))
    assert all(k % 30 in want[k] for k in range(60)) and want[60:] == [{}] * 4
    monkeypatch.setattr(decontaminate, "FOLDED", 7)
    assert decontaminate.judge(index, pa.array(texts)) == want
    assert [decontaminate.judge(index, pa.array([t], pa.string()))[0] for t in texts] == want


def test_frequencies_of_passages():
    import pyarrow as pa

    texts = [prose(r.randint(0, 150)) + " w1 w2" * r.randint(0, 40) for _ in range(50)]
    names = sorted({w for t in texts for w in t.split()})
    of = decontaminate.Coded(pa.array(texts), pa.array(names))
    want = dict.fromkeys(names, 0)
    for t in texts:
        w = t.split()
        for h in range(max(1, -(-len(w) // 32) - 1) if w else 0):
            for x in set(w[h * 32 : h * 32 + 64]):
                want[x] += 1
    assert of.frequencies(len(names)).tolist() == [want[x] for x in names]
