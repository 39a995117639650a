"""Sharding and packing: exact laws, and the optimum against all choices."""

import itertools
import math
import random
import zlib
from collections import Counter

from copperbook.llm import packing as pk
from copperbook.llm import sharding as sh


def test_law_of_one_draw():
    rng = random.Random(2)
    seen = Counter(sh.hypergeometric(rng, 7, 9, 6) for _ in range(20000))
    for k in range(7):
        chance = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert abs(seen[k] / 20000 - chance) < 0.02


def test_matrix_sums():
    sizes, room = [5, 0, 17, 100, 3], [16, 16, 16, 16, 16, 15, 15, 15]
    matrix = sh.communication_matrix(sizes, room, 1)
    assert [sum(r) for r in matrix] == sizes
    assert [sum(c) for c in zip(*matrix)] == room


def test_large_draws_stay_inside():
    rng = random.Random(3)
    for _ in range(200):
        n = sh.hypergeometric(rng, 10**12, 7 * 10**12, 10**6)
        assert abs(n - 125_000) < 3000


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = sh.shard_documents(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body)
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_shuffle_is_uniform(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    seen = Counter((r["doc_id"] * 4 // 4000, r["shard"]) for r in sh.shard_rows(rows, 4).collect())
    chi = sum((seen[a, b] - 250) ** 2 / 250 for a in range(4) for b in range(4))
    assert chi < 30  # 9 degrees of freedom


def test_equal_rows_and_nulls(spark):
    df = spark.createDataFrame([(None, None)] * 900 + [(1, "x")] * 100, "doc_id long, text string")
    rows = sh.shard_documents(df).collect()
    assert Counter(r["shard"] for r in rows) == {k: 125 for k in range(8)}
    assert Counter(r["size"] for r in rows) == {1: 900, 2: 100}
    few = sh.shard_documents(df.limit(3)).collect()
    assert sorted(r["shard"] for r in few) == [0, 1, 2] and {r["slot"] for r in few} == {0}
    assert sh.shard_documents(df.limit(0)).count() == 0


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in histogram.items())


def test_boundaries_are_best():
    rng = random.Random(4)
    for _ in range(150):
        histogram = {rng.randrange(40): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        buckets = rng.randrange(1, 5)
        found = pk.best_boundaries(list(histogram), list(histogram.values()), buckets)
        lengths = sorted(histogram)
        best = min(
            padding(histogram, [*cut, lengths[-1]])
            for n in range(buckets)
            for cut in itertools.combinations(lengths[:-1], n)
        )
        assert len(found) <= buckets and padding(histogram, found) == best
    assert pk.best_boundaries([], [], 4) == []


def test_packed_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    rows = pk.pack(docs, longest=256, buckets=5, budget=1000).collect()
    for doc, n in words.items():
        own = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == doc)
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [f for _, f, _ in own] == [256 * p for p, _, _ in own] and sum(t for _, _, t in own) == n
    batches = Counter((r["bucket"], r["batch"]) for r in rows)
    assert len({(r["bucket"], r["batch"], r["batch_row"]) for r in rows}) == len(rows)
    for (bucket, batch), n in batches.items():
        length = next(r["bucket_length"] for r in rows if r["bucket"] == bucket)
        room = max(1, 1000 // length)
        last = batch == max(b for k, b in batches if k == bucket)
        assert n == room or (last and n < room)
    assert all(r["n_tokens"] <= r["bucket_length"] for r in rows)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "w " * 5000)], "doc_id long, text string")
    rows = pk.pack(df).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == {
        (1, 0): 1, (2, 0): 1, (None, 2): 2, (3, 2048): 2, (3, 904): 1,
    }
    assert pk.pack(df.limit(0)).count() == 0
