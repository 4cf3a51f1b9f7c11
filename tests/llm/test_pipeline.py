"""Decontamination and the pipeline, stage by stage."""

import os
import random

import numpy as np
import pytest

from tallyframe.llm import decontaminate, registry

r = random.Random(13)
WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu") for c in ("", "n", "sh", "x")]
COMMON = ["the", "of", "and", "to", "in", "is"]


def prose(n):
    return " ".join(r.choice(COMMON) if r.random() < 0.4 else r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


DDL = "doc_id bigint, text string, items string, share string, term int"


def test_items_are_found_and_clean_texts_left(spark):
    items = [(k, prose(r.randint(15, 60))) for k in range(30)] + [(50, prose(150)), (51, None), (None, prose(20)), (52, "")]
    clean = [(k, prose(r.randint(1, 400))) for k in range(100)]
    planted, want = [], {}
    for k in range(60):
        item, text = items[k % 31]
        words = text.split()
        if k % 3 == 1:  # every ninth word replaced
            words = [w if j % 9 else "zzz" for j, w in enumerate(words)]
        if k % 3 == 2:
            words = [w.upper() + "," for w in words]
        planted.append((1000 + k, f"{prose(r.randint(0, 300))} {' '.join(words)} {prose(r.randint(0, 300))}"))
        want[1000 + k] = item
    odd = [(900, None), (901, ""), (902, "..."), (903, "the " * 50_000), (1000, planted[0][1]), (None, planted[1][1])]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in clean + planted + odd], DDL)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.judged(docs, decontaminate.fitted(docs, bench)).collect()
    assert len(got) == 166
    for x in got:
        if x["doc_id"] in want:
            assert want[x["doc_id"]] in x["_b_items"]
        elif x["doc_id"] is not None:
            assert x["_b_items"] == []
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 104
    assert decontaminate.decontaminated(docs.limit(0), bench).collect() == []
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == 166


def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j] + 1 if x == y else 0, row[j + 1]) for j, y in enumerate(b)]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        return row[-1]

    for _ in range(200):
        a, b = (r.choices("abcd", k=r.randint(0, 12)) for _ in range(2))
        assert decontaminate.common_length(a, b) == plain(a, b)


def test_directions_span_the_items(spark):
    """With as many directions as passages, the randomised SVD spans all of them."""
    items = [(k, prose(40)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.Index(items)
    axes = decontaminate.directions(bench, spark.sparkContext.broadcast(index), index)
    found = index.rows([t for _, t in items])
    rows = np.zeros((len(found), index.terms))
    for k, (_, term, v) in enumerate(found):
        rows[k, term] = v
    assert np.abs(rows @ axes @ axes.T - rows).max() < 1e-3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline
    from tallyframe.llm import bpe, exact_dedup, quality
    from tallyframe.llm.common import documents, table

    d = "/root/testdata/sf0.001"
    docs = documents(spark, d)
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        if name != "tokens":
            assert out.columns == documents(spark, d).columns
        at[name] = {x["doc_id"]: x for x in out.collect()}
        docs = out
    all_ = {x["doc_id"]: x["text"] or "" for x in documents(spark, d).collect()}
    keep = {x["doc_id"] for x in quality.judged(documents(spark, d), table(spark, d, "labels")).where("_q_keep").collect()}
    assert set(at["quality"]) == keep
    last = {}
    for i in sorted(keep):
        last[all_[i]] = i
    assert set(at["exact_dedup"]) == set(last.values())
    words = {i: all_[i].encode().lower().split() for i in last.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    linked = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    seen, roots = set(), set()
    for i in sorted(sets):
        if i not in seen:
            roots.add(i)
            todo = [i]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    todo += [b for b in sets if b not in seen and linked(a, b)]
    assert set(at["near_dedup"]) == roots
    items = [x["text"] for x in table(spark, d, "benchmark").collect()]
    assert not any(t in all_[i] for t in items for i in at["decontamination"])
    assert set(at["tokens"]) == set(at["decontamination"])
    t = bpe.tokenizer(bpe.vocabulary())
    assert all(x["n_tokens"] == len(t.encode(all_[i], add_special_tokens=False).ids) for i, x in at["tokens"].items())
    assert exact_dedup.BLOCK > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_run_with_nulls_empty_tables_and_more_columns(spark, tmp_path):
    """run() itself, on a folder with null ids, null and empty texts, repeated rows and columns of clashing names; and on an empty table."""
    import corpus_pipeline

    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "a text that has no id of its own at all", "en", "s"), (90001, None, None, None), (90002, "", "en", "s"), (90003, "twice the same row", "en", "s"), (90003, "twice the same row", "en", "s")], "doc_id bigint, text string, lang string, source string")
    more = src.unionByName(odd, allowMissingColumns=True).selectExpr("*", "1 as row", "'n' as name", "2 as term")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    more.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [x["doc_id"] for x in out]
    assert len(ids) == len(set(ids)) and set(ids) <= {x["doc_id"] for x in more.select("doc_id").collect()}
    more.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
