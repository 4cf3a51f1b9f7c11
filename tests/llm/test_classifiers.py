"""Quality, toxicity, urls and secrets: edge cases and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import quality, secrets, toxicity, url_filter

DDL = "doc_id bigint, text string, lang string, source string, n int, k int, score double, rate double"
r = random.Random(8)
WORDS = [f"{a}{b}{c}" for a in ("the", "ran", "or", "mil") for b in ("ing", "ed", "o", "ta") for c in ("", "s", "ly")]


def prose(n):
    return " ".join(r.choices(WORDS, k=n)) + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, 2, 0.5, 0.5) for i, t, lang, src in rows], DDL)


def test_quality(spark):
    rows = [(k, prose(r.randint(20, 80)) if k % 4 else " ".join(w.upper() + "!!" for w in prose(40).split()), "en", "s0" if k % 3 else f"s{k}") for k in range(200)]
    odd = [(900, None, None, None), (901, "", "en", "s0"), (902, "x" * 200_000, "en", "s0"), (1, rows[1][1], "en", "s0"), (None, prose(30), "en", "s0")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 200, 2)] + [(5, None), (7, 0), (7, 1), (None, 1)], "doc_id bigint, quality int")
    out = quality.judged(frame(spark, rows + odd), labels).collect()
    assert len(out) == len(rows) + len(odd)
    assert all(x["_q_keep"] == (x["doc_id"] % 4 > 0) for x in out if x["doc_id"] is not None and x["doc_id"] < 200)
    assert all(0 <= x["_q_score"] <= 1 for x in out)
    kept = quality.accepted(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns and kept.count() == 150
    assert quality.judged(frame(spark, []), labels).collect() == []
    assert quality.accepted(frame(spark, rows), labels.limit(0)).count() == 200


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [(k, prose(40), "en", "good") for k in range(120)] + [(200 + k, " ".join(w.upper() + "!!" for w in prose(30).split()), "en", "bad") for k in range(60)] + [(900, prose(40), "xx", "good"), (901, prose(40), "xx", "bad")]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows[:180]], "doc_id bigint, quality int")
    got = {x["doc_id"]: x["_q_path_rate"] for x in quality.judged(frame(spark, rows), labels).collect()}
    assert got[900] > got[901]


def test_toxicity_finds_held_out_texts(spark):
    bad = ["gruntle", "gruntled", "vexmor", "vexmora", "snarkly"]
    rows = []
    for k in range(400):
        w = prose(r.randint(30, 120)).split()
        if k % 5 == 1:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), "en", "s"))
    odd = [(900, None, None, None), (901, "", "en", "s"), (902, "   ", "en", "s"), (903, "word " * 30_000 + "vexmor", "en", "s"), (None, "gruntle", "en", "s"), (1, rows[1][1], "en", "s")]
    labels = spark.createDataFrame([(k, int(k % 5 == 1)) for k in range(400)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    docs = frame(spark, rows + odd)
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows) + len(odd)
    held = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 400 and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40
    assert np.mean([(x["_t_score"] >= 0.5) == (x["doc_id"] % 5 == 1) for x in held]) > 0.97
    by = {x["doc_id"]: x for x in out}
    assert by[903]["_t_score"] >= 0.5 and [(s["begin"], s["end"]) for s in by[903]["_t_spans"]] == [(150_000, 150_006)]
    assert by[901]["_t_score"] < 0.5 and by[900]["_t_spans"] == []
    assert all(w.strip(".") in bad for x in held for s in x["_t_spans"] for w in x["text"][s["begin"] : s["end"]].split())
    assert toxicity.scored(frame(spark, []), toxicity.Field()).collect() == []
    none = toxicity.train(docs, labels.limit(0))
    assert all(x["_t_score"] < 0.5 for x in toxicity.scored(docs, none).collect())


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(9)
    u, move = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    weigh = lambda y: np.exp(sum(u[0, t] * y[t] for t in range(5)) + sum(move[y[t], y[t + 1]] for t in range(4)))
    paths = [tuple(k >> t & 1 for t in range(5)) for k in range(32)]
    z = sum(map(weigh, paths))
    m, moved = toxicity.marginals(u, move)
    assert m[0] == pytest.approx([sum(weigh(y) for y in paths if y[t]) / z for t in range(5)])
    assert moved[0, 1] == pytest.approx(sum(weigh(y) * sum(y[t] == 0 and y[t + 1] == 1 for t in range(4)) for y in paths) / z)


def test_rules_of_urls(spark):
    urls = {
        "https://a.com/x": ("a.com", "/x", "com/", "allow"), "HTTP://WWW.Example.COM/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://m.example.com/en/2#t": ("m.example.com", "/en/2", "example.com/en/", "block"),
        "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"), "http://a.net/es": ("a.net", "/es", None, None), "http://com": ("com", "", None, None), "http://notcom/": ("notcom", "/", None, None), "http://a.com?x": ("a.com", "", None, None),
        "nothing": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "x://y://z.com/": ("y:", "//z.com/", None, None), "http://a.net/FR/": ("a.net", "/FR/", None, None),
    }
    rows = [(k, u, "h", "r", "v") for k, u in enumerate([*urls, *urls])]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id int, url string, host string, rule string, verdict string")).collect()
    assert len(got) == len(rows)
    for x in got:
        host, path, rule, verdict = urls[x["url"]]
        assert (x["_u_host"], x["_u_path"], x["_u_rule"]) == (host, path, rule)
        assert x["_u_verdict"] == verdict if verdict else x["_u_verdict"] in ("allow", "block")
    assert url_filter.judged(spark.createDataFrame([], "url string")).collect() == []


def test_url_models_tell_classes_apart(spark):
    good = [f"https://{r.choice(WORDS)}.com/{r.choice(WORDS)}-{r.choice(WORDS)}" for _ in range(300)]
    bad = [f"http://{r.choice(WORDS)}.net/es/{r.randint(1, 10**6)}/buy-{r.randint(1, 99)}" for _ in range(300)]
    fresh = [(f"https://{r.choice(WORDS)}.org/{r.choice(WORDS)}-{r.choice(WORDS)}", "allow") for _ in range(50)] + [(f"http://{r.choice(WORDS)}.org/es/{r.randint(1, 10**6)}/buy-{r.randint(1, 99)}", "block") for _ in range(50)]
    frame_ = spark.createDataFrame([(u,) for u in good + bad + [u for u, _ in fresh]], "url string")
    got = {x["url"]: x["_u_verdict"] for x in url_filter.judged(frame_).collect()}
    assert np.mean([got[u] == v for u, v in fresh]) > 0.95
    m = url_filter.Markov(good, 3)
    assert sum(m.chance("ing"[:2] + chr(c)) for c in range(256)) == pytest.approx(1)


def secret_rows():
    out = []
    for k in range(150):
        hexed = "".join(r.choices("0123456789abcdef", k=40))
        key = "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=15)) + "7"
        found = [(f'token = "{hexed}"', 1), (f"{key}", 1), (f"password={hexed[:18]}", 1), (f"{r.choice(WORDS)}.{k}@mail.example.com", 0), (f"{r.randint(10**15, 10**16 - 1)}", 0), (f"https://x.org/{r.choice(WORDS)}/{k}/page", 0)][k % 6]
        out.append((k, f"{prose(8)} {found[0]} {prose(8)}", "en", "docs/test"))
    return out


def test_secrets(spark):
    rows = secret_rows()
    odd = [(900, None, None, None), (901, "", "en", "s"), (902, "b" * 50_000 + "1", "en", "s"), (0, rows[0][1], "en", "docs/test"), (None, rows[1][1], "en", None)]
    got = secrets.scan(frame(spark, rows + odd)).collect()
    first = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 150]
    assert {x["doc_id"] for x in first if x["secret"]} == {k for k in range(150) if k % 6 < 3}
    assert len([x for x in first if x["doc_id"] == 0]) == 2
    assert secrets.scan(frame(spark, [])).collect() == []
    findings = spark.createDataFrame([(x["candidate"], bool(x["secret"])) for x in first[:80]] + [(None, True), ("x", None)], "candidate string, is_secret boolean")
    again = secrets.scan(frame(spark, rows), findings).collect()
    assert np.mean([x["secret"] == (x["doc_id"] % 6 < 3) for x in again]) > 0.95


def test_forest_column_equals_the_trees(spark):
    rng = random.Random(12)
    rows = [([rng.random() for _ in secrets.FEATURES], int(rng.random() < 0.5)) for _ in range(120)]
    trees = secrets.forest(rows, 3)

    def walk(t, x):
        return t if isinstance(t, float) else walk(t[2] if x[t[0]] <= t[1] else t[3], x)

    df = spark.createDataFrame([x for x, _ in rows], ", ".join(f"{f} double" for f in secrets.FEATURES))
    got = [v[0] for v in df.select(secrets.compiled(trees)).collect()]
    assert got == pytest.approx([sum(walk(t, x) for t in trees) / 3 for x, _ in rows])
    assert df.select(secrets.compiled([0.5])).first()[0] == 0.5


def test_chain_over_blocks_equals_one_long_chain():
    rng = np.random.default_rng(4)
    move = np.array([[0.0, -1.5], [-0.7, 1.2]])
    lengths = np.array([1, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 3 * toxicity.WINDOW - 1, 1000])
    field = toxicity.Field()
    field.move = move
    texts = [[f"w{rng.integers(50)}" for _ in range(n)] for n in lengths] + [[]]
    field.known = {f"w{k}": float(x) for k, x in enumerate(rng.normal(0, 3, 50))}
    for t, got in zip(texts, field.tagged(texts), strict=True):
        if t:
            want, _ = toxicity.marginals(np.array([[field.known[w] for w in t]]), move)
            assert np.abs(got - want[0]).max() < 1e-9
        else:
            assert len(got) == 0


def test_url_models_equal_a_plain_computation():
    """Witten-Bell by recursion over counts of every context, whole urls, against the operator's models."""
    good = [f"a{k}.com/en/page-{k * k}?" for k in range(40)] + ["x.com/" + "deep/" * 100]
    bad = [f"b{k}.net/es/{k}/spam" for k in range(40)]
    ratio = url_filter.Ratio(good, bad)
    held = lambda u: zlib.crc32(u.encode()) % 4 == 0

    def plain(texts, gram):
        if len(gram) == 1:
            seen = [c for t in texts for c in t[5:]]
            return (seen.count(gram) + len(set(seen)) / 256) / (len(seen) + len(set(seen)))
        after = [t[i] for t in texts for i in range(5, len(t)) if t[: i].endswith(gram[:-1])]
        shorter = plain(texts, gram[1:])
        return shorter if len(after) < 2 else (after.count(gram[-1]) + len(set(after)) * shorter) / (len(after) + len(set(after)))

    pad = lambda us: ["\x02" * 5 + u + "\x03" for u in us if not held(u)]
    for url in (good[3], bad[5], "new.org/" + "deep/" * 60, ""):
        t = "\x02" * 5 + url + "\x03"
        want = sum(np.log(plain(pad(good), t[i - 5 : i + 1]) / plain(pad(bad), t[i - 5 : i + 1])) for i in range(5, len(t))) / (len(url) + 1)
        assert ratio(url) == pytest.approx(want, abs=1e-9)


def test_long_urls_and_clashing_columns(spark):
    urls = [(k, f"http://{h}/p{k}", "h", "v") for k, h in enumerate(["a.com", "www.example.com/en", "b.net/es", "c.org"] * 20)] + [(900, "http://a.com/" + "x" * 50_000, "h", "v"), (901, None, None, None), (902, "no scheme", "h", "v"), (902, "no scheme", "h", "v")]
    df = spark.createDataFrame(urls, "page_id bigint, url string, host string, verdict string")
    out = url_filter.judged(df).collect()
    assert len(out) == len(urls) and all(x["_u_verdict"] in ("allow", "block") for x in out)
    assert url_filter.judged(df.limit(0), model=url_filter.Ratio([], [])).collect() == []


def test_own_posterior_is_left_out_of_rates(spark):
    rows = [(1, prose(40), "en", "solo")] + [(10 + k, prose(40), "en", "other") for k in range(50)] + [(100 + k, " ".join(w.upper() + "!!" for w in prose(30).split()), "en", "other") for k in range(50)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, *_ in rows[1:]], "doc_id bigint, quality int")
    got = {x["doc_id"]: x for x in quality.judged(frame(spark, rows), labels).collect()}
    assert got[1]["_q_path_rate"] == pytest.approx(got[1]["_q_host_rate"]) and 0.3 < got[1]["_q_host_rate"] < 0.7


@pytest.mark.parametrize("n", [0, 1, 7, 2990, 3000, 4000])
def test_least_hashed_rows_are_the_least(spark, n):
    from pyspark.sql import functions as F

    from tallyframe.llm.common import least_hashed

    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    want = sorted((x["h"], x["id"]) for x in rows.collect())[:n]
    assert sorted((x["h"], x["id"]) for x in least_hashed(rows, "h", n, ["id"]).collect()) == want
