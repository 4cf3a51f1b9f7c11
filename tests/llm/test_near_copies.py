"""The pipeline's near copies against brute force."""

import random

import pytest

import corpus_pipeline
from tallyframe.llm import near_copies

DDL = "doc_id bigint, text string, level int"


def sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("sample, often, large", [(near_copies.SAMPLE, near_copies.OFTEN, near_copies.LARGE), (1, 2, 2)])
def test_near_stage_equals_brute_force(spark, monkeypatch, sample, often, large):
    """Pairs of similarity 0.8 and more whose fingerprints differ in far more than 3 bits, chains, short texts and a line that all share."""
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "OFTEN", often)
    monkeypatch.setattr(near_copies, "LARGE", large)
    r = random.Random(21)
    line = " ".join(f"line{k}" for k in range(12))
    texts = [None, "", " \n", "a b", "A  B", "x", line, line.upper()]
    for _ in range(15):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([6, 30, 150, 600]))]
        for edits in (0, 0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(w if r.random() > edits else f"e{r.randrange(9999)}" for w in base) + " " + line)
    rows = [*enumerate(texts), (None, texts[9] + " more"), (None, "only here and nowhere else at all"), (None, "another text with no id"), (4, "one id on two texts")]
    found = [sets(t) for _, t in rows]
    linked = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(found[i], found[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    want = sorted(min((i is None, i or 0) for (i, _), x in zip(rows, root, strict=True) if x == k) for k in set(root))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], DDL)
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in got.collect()) == want
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").collect() == []
