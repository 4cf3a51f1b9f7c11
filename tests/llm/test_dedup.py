"""Exact and near dedup against brute force."""

import hashlib
import random

import xxhash

from tallyframe.llm import components, exact_dedup, simhash

LONG = "".join(random.Random(1).choices("abc é\n", k=30_000))
EXTRA = "doc_id bigint, text string, level int, name string, block string, fp string, _x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", "b", "f", 2) for i, t in rows], EXTRA)


def test_exact_dedup_equals_brute_force(spark):
    r = random.Random(2)
    texts = ["", None, "a", "b", LONG, LONG[:-1], LONG + "x", LONG[:4096], LONG[:8192], LONG[:4096] * 2, "a" * 8192, "a" * 8193, " a"]
    rows = [(k, r.choice(texts)) for k in range(60)] + [(3, "a"), (3, "a"), (3, "b"), (None, "a"), (None, "only here")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {t: (max([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for x in got:
        assert (x["keep_id"], x["group_size"]) == want[sha[x["text_sha256"]]]
    assert sum(x["kept"] for x in got) == len(groups)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []
    left = exact_dedup.deduplicated(frame(spark, rows))
    assert left.columns == frame(spark, []).columns
    assert sorted(((x["text"] or "", x["doc_id"]) for x in left.collect()), key=str) == sorted(((t, k) for t, (k, _) in want.items()), key=str)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    base = [" ".join(r.choices([f"w{k}" for k in range(300)], k=r.randint(1, 400))) for _ in range(12)]
    texts = [None, "", "  \n", "A b", "a  B", "x", *base]
    for t in base:
        for _ in range(6):
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [*enumerate(texts), (5, "x"), (900, base[0].upper()), (None, base[1])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    assert sorted((x["doc_id"] is None, x["doc_id"], x["fingerprint"]) for x in got) == sorted((i is None, i, f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True))
    kinds = sorted(set(fps))
    root = roots(kinds, [(a, b) for a in kinds for b in kinds if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = {f"{f:016x}": least.get(root[f]) for f in kinds}
    assert all(x["component_id"] == want[x["fingerprint"]] for x in got)
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert sorted(x["doc_id"] for x in simhash.deduplicated(frame(spark, [k for k in rows if k[0] is not None])).collect()) == sorted(set(least.values()))


def test_no_link_is_lost(spark):
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(300)]
    for x in values[:150]:
        for flips in (1, 2, 3, 4):
            y = x
            for b in r.sample(range(64), flips):
                y ^= 1 << b
            values.append(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    kinds = sorted({signed(x) for x in values})
    got = {tuple(p) for p in simhash.links(spark.createDataFrame([(x,) for x in kinds], "fp bigint")).collect()}
    want = {(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 21)} | {k: 100 for k in range(101, 130)}


def test_names_do_not_depend_on_partitions(spark):
    rows = [(k, f"text {k % 37} " * (1 + k % 9)) for k in range(300)] + [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(str, exact_dedup.identities(docs.repartition(int(n)), block=16).select("id", "level", "name").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1]


def test_stored_tables_can_be_dropped(spark, tmp_path):
    import os

    from tallyframe.llm import common

    common._STORED.pop(spark.sparkContext.applicationId, None)
    common.stored(spark.range(3), "to-drop")
    folder = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    assert any(n.startswith("to-drop-") for n in os.listdir(folder))
    assert common.drop_stored(spark) == 1 and not any(n.startswith("to-drop-") for n in os.listdir(folder))
