"""Secret spans against regular expressions of Python; the battery on known texts."""

import hashlib
import random
import re

from copperbook.llm import secrets as sc

_LETTERS = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")}
_ASSIGN = re.compile(
    rf"""({_LETTERS["password"]}|{_LETTERS["passwd"]}|{_LETTERS["secret"]}|{_LETTERS["token"]}|{_LETTERS["api"]}_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = ("assign", "access", "hex")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def base(text):
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def check(rows, texts):
    for r in rows:
        spans = base(texts[r["doc_id"]] or "")
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(sc.scan(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_made_texts(spark):
    rng = random.Random(3)
    bits = ["password", "PassWD", "toKen", "secret", "api_key", "apikey", "=", ": ", " ", '"', "'", "é", "😀", "\x01", "\x02", "\n",
            "abcdefgh", "1234567", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "-._=+/", "ſecret"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(12)))) for k in range(3000)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, spans int")
    found = sc.scan(df).collect()
    assert len(found) == len(rows)
    check(found, dict(rows))


def test_random_runs_are_found_and_names_are_not(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choices(ALPHABET, k=rng.choice([24, 32, 40]))) for _ in range(100)]
    names = ["the-quick-brown-fox-2024-jumps", "/usr/local/lib/python3/site-packages", "InternationalBusinessMachines1999",
             "chapter_12_section_04_paragraph", "20240101000000000000", "a" * 25 + "1", "version2/very-long-address-name"]
    rows = [(k, f"some é words {key} and more") for k, key in enumerate(keys)]
    rows += [(1000 + k, f"words {name} words") for k, name in enumerate(names * 10)]
    found = {r["doc_id"]: r["spans"] for r in sc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[k] == f"random:13:{13 + len(key)}" for k, key in enumerate(keys)) >= 90
    assert all(found[1000 + k] == "" for k in range(len(names) * 10))


def test_secrets_glued_to_names_and_paths_are_found_alone(spark):
    rng = random.Random(6)
    fronts = ["AWS_SECRET_ACCESS_KEY=", "DATABASE_CREDENTIAL_STRING=", "key=", "sk_live_", "/srv/data/keys/", "Client-Id-", "a=b="]
    rows, wanted = [], {}
    for k in range(210):
        front, n = fronts[k % 7], rng.choice([28, 32, 40])
        key = "".join(rng.choices(ALPHABET, k=n - 1)) + "7" + "=" * (k % 3)
        rows.append((k, f"some é words {front}{key} more"))
        wanted[k] = (13, 13 + len(front), 13 + len(front) + len(key))
    rows += [(1000 + k, f"words {name} words") for k, name in enumerate(
        ["MAXIMUM_NUMBER_OF_CONNECTIONS=configuration2value", "/usr/share/internationalization2data/files", "an-extraordinarilylongword1-name"] * 10)]
    found = {r["doc_id"]: r["spans"] for r in sc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {k: [tuple(map(int, s.split(":")[1:])) for s in found[k].split(",") if s] for k in wanted}
    assert sum(len(h) == 1 and a <= h[0][0] <= b and h[0][1] == end for k, (a, b, end) in wanted.items() for h in [hit[k]]) >= 200
    assert all(hit[k][0][0] == b for k, (_, b, _) in wanted.items() if hit[k] and rows[k][1][b - 1] == "=" )
    assert all(found[1000 + k] == "" for k in range(30))


def test_short_hex_after_a_name_is_found_as_often_as_alone(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choices("0123456789abcdef", k=28)) for _ in range(100)]
    shares = []
    for front in ("", "key=", "AWS_SECRET_ACCESS_KEY="):
        rows = [(k, f"some words {front}{key} and more") for k, key in enumerate(keys)]
        found = sc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        shares.append(sum(bool(r["spans"]) for r in found))
    assert shares[0] == shares[1] == shares[2] > 50


def test_redaction(spark):
    key = "".join(random.Random(5).choices(ALPHABET, k=40))
    rows = [(1, None, 1), (2, "", 1), (3, "no secret here", 1), (4, f"é password='hunter2hunter2' then {'0f' * 20} end", 1), (None, "token: " + "ab12" * 10, 1)]
    rows += [(10 + k, f"key {key} tail", 1) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __x int")
    out = sc.redact(df)
    assert out.columns == df.columns
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert found[1] is None and found[2] == "" and found[3] == "no secret here"
    assert found[4] == "é [secret]' then [secret] end" and found[None] == "[secret]"
    assert found[10] == "key [secret] tail"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sc.scan(empty).count() == 0 and sc.redact(empty).count() == 0


def test_long_text(spark):
    text = ("word " * 200 + "token=" + "x1" * 20 + "\n") * 300
    (row,) = sc.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    check([row], {1: text})
    assert row["n_assign"] == 300


def test_spans_of_one_text_against_all_pairs(spark):
    """Which added spans stay, against a comparison of each with all others."""
    from pyspark.sql import functions as F

    rng = random.Random(8)

    def spans(most):
        return sorted({(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(most)))})

    rows = [(n, [(a, rng.randrange(3), b) for a, b in spans(8)], [(a, 3, b) for a, b in spans(14)]) for n in range(300)]
    kind = "array<struct<start:int,kind:int,end:int>>"
    df = spark.createDataFrame(rows, f"n int, base {kind}, added {kind}")
    found = {r.n: [tuple(x) for x in r.f] for r in df.select("n", sc._fresh(F.col("base"), F.col("added")).alias("f")).collect()}
    for n, base_spans, added in rows:
        wanted = [
            (a, k, b)
            for a, k, b in added
            if not any(x < b and a < y for x, _, y in base_spans)
            and not any(x <= a and b <= y and y - x > b - a for x, _, y in added)
        ]
        assert found[n] == sorted(wanted)


def test_a_text_with_very_many_secrets(spark):
    """A log with a hash a line: time in proportion, all found, all masked."""
    rng = random.Random(9)
    lines = [f"é {k} " + "".join(rng.choices("0123456789abcdef", k=40)) for k in range(6_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    (row,) = sc.scan(df).collect()
    assert row["n_hex"] == 6_000
    check([row], {1: "\n".join(lines)})
    (masked,) = sc.redact(df).collect()
    assert masked["text"] == "\n".join(f"é {k} [secret]" for k in range(6_000))
