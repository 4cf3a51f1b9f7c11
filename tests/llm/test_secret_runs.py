"""Every run of a word is a candidate of the secret scan."""

from tallyframe.llm import secrets

HEX = "0123456789abcdef0123456789abcdef01234567"
KEY_ID = "AKIA" + "Q7ZW2X9B4M1N8K3P"


def test_all_runs_of_a_word_are_candidates(spark):
    texts = [
        '{"id":"customer-records","aws_access_key_id":"%s","secret":"%s"}' % (KEY_ID, HEX),
        f"see https://x.org/a?session={HEX}&token={KEY_ID},{HEX}",
        "password=correcthorsebattery passwd=tiny secret: short next",
        "QWxhZGRpbjpvcGVuIHNlc2FtZTEyMw== plainlongwordwithoutdigits a=b",
    ]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {}
    for x in secrets.candidates(docs).collect():
        got.setdefault(x["id"], []).append(x["candidate"])
    assert {k: sorted(v) for k, v in got.items()} == {
        0: sorted([KEY_ID, HEX]),
        1: sorted([HEX, KEY_ID, HEX]),
        2: sorted(["correcthorsebattery", "tiny", "short"]),
        3: ["QWxhZGRpbjpvcGVuIHNlc2FtZTEyMw=="],
    }


def test_recall_of_planted_secrets(spark):
    """Secrets in configuration lines, JSON without spaces, query strings and prose, among ids, links, numbers, addresses and long words."""
    import random

    r = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(r.choices(letters, k=n))
    hexed = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    key = lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=15)) + "7"
    plants = [
        lambda s: f"api_key = {s}", lambda s: f'{{"id":"{word(9)}","secret":"{s}","n":{r.randint(1, 99)}}}', lambda s: f"http://x.org/?a={word(4)}&token={s}", lambda s: f"password={s}", lambda s: f"auth_token: {s}",
        lambda s: f"{s}",
    ]
    rows, want = [], set()
    for k in range(240):
        kind = k % 6
        secret = key() if kind == 5 or k % 4 == 0 else hexed(40) if k % 4 == 1 else hexed(8) + word(8) + "9"
        noise = [f"{word(r.randint(2, 9))}" for _ in range(30)] + [f"{word(6)}.{r.randint(1, 99)}@{word(5)}.example", f"https://{word(6)}.org/{word(5)}/{r.randint(1, 10**6)}", f"{r.randint(10**13, 10**15)}", f"2024-0{r.randint(1, 9)}-11T10:00:00", word(18)]
        r.shuffle(noise)
        rows.append((k, " ".join([*noise[:15], plants[kind](secret), *noise[15:]]), "s"))
        want.add((k, secret))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("secret").collect()
    found = {(x["doc_id"], x["candidate"]) for x in got}
    assert len(found & want) >= 0.9 * len(want)
    assert len(found & want) >= 0.9 * len(found)
