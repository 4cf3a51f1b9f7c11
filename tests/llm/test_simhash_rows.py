"""One row of each component of fingerprints, whatever the ids."""

from tallyframe.llm import simhash


def test_null_and_repeated_ids_keep_their_texts(spark):
    texts = [f"{w} " * 3 + " ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (9, texts[4].upper()), (8, texts[4])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, level int")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])]
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted(want, key=str)
