"""Pigeonhole matching against plain edit distances."""

import random

from copperbook.llm import decontamination as dc


def plain_end(pattern, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(pattern, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_bit_vectors():
    rng = random.Random(3)
    for _ in range(1500):
        pattern = "".join(rng.choices("abc ", k=rng.randrange(1, 14)))
        text = "".join(rng.choices("abc ", k=rng.randrange(25)))
        assert dc.best_end(pattern, text) == plain_end(pattern, text)


def test_every_occurrence_within_the_budget_is_found():
    rng = random.Random(4)
    items = [(k, " ".join("".join(rng.choices("abcde", k=rng.randrange(2, 7))) for _ in range(20))) for k in range(12)]
    matcher = dc.Matcher(items)
    for _ in range(250):
        item_id, item = rng.choice(items)
        text = list(f"{rng.choice(items)[1][:30]} {item} {rng.choice(items)[1][:30]}")
        for _ in range(rng.randrange(9)):
            text[rng.randrange(len(text))] = rng.choice("abcdexyz")
        plain = dc.normalised("".join(text))
        wanted = set()
        for k, other in items:
            other = dc.normalised(other)
            distance, _ = plain_end(other, plain)
            if distance <= len(other) // dc.PER_ERROR:
                wanted.add((k, distance))
        assert {(k, d) for k, d, _, _ in matcher.find("".join(text))} == wanted


def test_places_and_best_distance():
    item = "alpha beta gamma delta epsilon zeta"
    matcher = dc.Matcher([(7, item)])
    (found,) = matcher.find(f"x {item[:-1]}y word; {item.upper()}!!")
    text = dc.normalised(f"x {item[:-1]}y word; {item.upper()}!!")
    assert found[:2] == (7, 0) and text[found[2] : found[3]] == item


def test_short_items_match_whole_words():
    matcher = dc.Matcher([(1, "cat"), (2, " "), (3, None)])
    assert [f[0] for f in matcher.find("the cat sat")] == [1]
    assert matcher.find("concatenate") == [] and matcher.find(None) == [] and matcher.find("") == []


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = {r["item_id"]: dc.normalised(r["text"]) for r in items.collect()}
    texts = {r["doc_id"]: dc.normalised(r["text"] or "") for r in docs.collect()}
    exact = {(d, k) for d, t in texts.items() for k, i in plain.items() if i in t}
    for block_bytes in (dc.BLOCK_BYTES, 1000):
        found = dc.matches(docs, items, block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found if r["distance"] == 0} == exact and exact
        left = dc.clean(docs, items, block_bytes=block_bytes)
        assert left.columns == docs.columns
        assert {r["doc_id"] for r in left.collect()} == set(texts) - {r["doc_id"] for r in found}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "a long benchmark question here"), (1, "a long benchmark question here"), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "A long, benchmark question here!", 1), (None, None, 2), (3, "", 3)], "doc_id long, text string, item_id int")
    assert [(r["doc_id"], r["item_id"]) for r in dc.matches(docs, items).collect()] == [(None, 1), (None, 1)]
    assert sorted(r["item_id"] for r in dc.clean(docs, items).collect()) == [2, 3]
    assert dc.matches(docs, items.limit(0)).count() == 0 and dc.clean(docs, items.limit(0)).count() == 3
    assert dc.matches(docs.limit(0), items).count() == 0
