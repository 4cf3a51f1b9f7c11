"""What an executor's Python holds at once is bounded below the batch."""

import random

import pyarrow as pa

from tallyframe.llm import rans
from tallyframe.llm.bpe import vocabulary


def test_op6_encodes_a_batch_in_small_groups_and_gives_whole_ids():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghé中") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(400)] + ["", None]
    texts += ["  ".join(word() for _ in range(300)) for _ in range(800)] + ["\n" + word(), "a\nb c", " "]
    r.shuffle(texts)
    of, sizes = rans.Ids(vocabulary("byte_bpe_50k.json")), []
    want = [of.of.encode(t or "", add_special_tokens=False).ids for t in texts]

    class Seen:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, batch, **rest):
            sizes.append(sum(len(t.encode()) for t in batch))
            return self.inner.encode_batch_fast(batch, **rest)

    of.of = Seen(of.of)
    ids, n = of.texts(pa.array(texts, pa.string()))
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    assert max(sizes) < 1_100_000 < sum(sizes)


def test_op10_counts_a_bucket_in_few_bytes_an_occurrence():
    import tracemalloc

    from tallyframe.llm import katz

    class Shared:
        value = katz.Model(200_000, 50_000, [9000, 5000, 3000, 2000, 1000, 800], {katz.word_hash(katz.END): 3000})

    r = random.Random(5)
    texts = [" ".join(f"w{int(r.paretovariate(0.5)) % 50_000}" for _ in range(100)) for _ in range(3000)]
    source = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts), pa.array([False] * 3000)], ["id", "text", "held"])
    rows = pa.Table.from_batches([x for x in katz._pairs(Shared, 1)(iter([source])) if x.column(1)[0].as_py() == 0])
    tracemalloc.start()
    katz._met(Shared, 1)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * 300_000, peak / 300_000


def test_decontamination_splits_two_megabytes_at_once_and_counts_all(monkeypatch):
    from tallyframe.llm import decontaminate

    class Shared:
        value = decontaminate.Index([(1, "alpha beta gamma")])

    sizes, coded = [], decontaminate.Coded
    monkeypatch.setattr(decontaminate, "Coded", lambda texts, names: sizes.append(texts.nbytes) or coded(texts, names))
    texts = pa.array(["alpha " + "x " * 2000] * 1500)
    out = next(decontaminate._frequencies(Shared)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))[0] == 1500
    assert max(sizes) < 2_200_000
