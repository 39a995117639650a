"""Packing with optimal length buckets.

Documents are cut into pieces of at most ``longest`` tokens. The histogram of
piece lengths covers all of them and has at most ``longest`` + 1 entries, so the
driver can hold it at any scale. Dynamic programming over it chooses the
boundaries of ``buckets`` buckets that cost the least padding in all. Inside a
bucket the pieces, in random order, fill batches of as many rows as a token
budget allows; only the last batch of a bucket can be short.

Numbers inside a bucket are made lot by lot, so that no task holds a bucket.

Rows: a text without tokens, null included, is one piece of no tokens; ties
between boundaries go to the shorter; repeated rows are packed each; an empty
table gives an empty result. Extra columns are ignored.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import numbered, only, stored
from copperbook.llm.sharding import LEAST_LOTS, LOT_ROWS, random_key

LONGEST = 2048
BUCKETS = 16
BUDGET = 16384


def word_count(text: Column) -> Column:
    """Tokens of the registered query: words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding."""
    order = np.argsort(lengths)
    length = np.asarray(lengths, np.int64)[order]
    rows = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64)[order])))
    n = len(length)
    if not n:
        return []
    # cost of the pieces up to j, as padded tokens; the real tokens are the same for any choice
    best = length * rows[1:]
    cuts = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        following, cut = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            cost = best[:j] + length[j] * (rows[j + 1] - rows[1 : j + 1])
            at = int(np.argmin(cost))
            if cost[at] < following[j]:
                following[j], cut[j] = cost[at], at + 1
        best = following
        cuts.append(cut)
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if j < 0:
            break
        bounds.append(int(length[j]))
        if cut is cuts[0]:
            break
        # a cut of zero means that fewer buckets are as good from here on
        if cut[j]:
            j = int(cut[j]) - 1
        else:
            bounds.pop()
    return sorted(set(bounds) | {int(length[-1])})


def pieces(docs: DataFrame, n_tokens: Column, longest: int) -> DataFrame:
    """A row per piece: piece number, first token and length."""
    cut = docs.withColumn("__n", n_tokens.cast("long")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("__n", F.lit(1)) - 1) / longest)))
    )
    return (
        cut.withColumn("first_token", F.col("piece") * longest)
        .withColumn("n_tokens", F.least(F.lit(longest).cast("long"), F.col("__n") - F.col("first_token")))
        .drop("__n")
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    count=word_count,
    seed: int = 29,
) -> DataFrame:
    """Per piece: doc_id, piece, first_token, n_tokens, bucket, bucket_length,
    batch (in its bucket) and batch_row."""
    plain = only(docs, id_col, text_col).toDF("doc_id", "text")
    slim = plain.select("doc_id", count(F.coalesce("text", F.lit(""))).alias("__tokens"))
    cut = pieces(slim, F.col("__tokens"), longest).drop("__tokens").withColumn("__key", random_key(seed))
    cut = stored(cut, "pieces")
    histogram = cut.groupBy("n_tokens").count().collect()
    bounds = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets) or [longest]
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = cut.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("n_tokens"))))
    lots = max(LEAST_LOTS, -(-sum(r[1] for r in histogram) // LOT_ROWS))
    full = numbered(placed, "__place", ["bucket"], [F.col("__key")], lots)
    length = F.get(edges, F.col("bucket"))
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(length, F.lit(1))))
    return full.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", length.alias("bucket_length"),
        F.floor(F.col("__place") / rows).alias("batch"),
        (F.col("__place") % rows).alias("batch_row"),
    )
