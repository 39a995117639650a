"""A uniform shuffle into shards of exact sizes.

Rows get random keys and fall into lots by the first. The communication matrix
says how many rows of each lot go to each shard: lot by lot it is drawn from the
multivariate hypergeometric law over what the shards still have room for, so
row sums are the sizes of the lots and column sums are exact. Within a lot the
rows are permuted by the second key and cut by the counts; after the exchange
each shard is permuted by the third. Any assignment with these sizes is equally
likely, and so is any order.

The driver holds one count per lot and the matrix; a lot is about
``LOT_ROWS`` rows, so that is a few numbers for each million rows. No window
holds more than a lot. Random keys are stored before they are used: a lost
executor cannot change them.

Rows: every row goes somewhere, repeated rows and nulls included (keys do not
depend on the row's values, so equal rows cannot gather in a lot); shards differ
by at most one row, the first ones being the larger; an empty table gives an
empty result; other columns are carried along, names beginning with two
underscores are taken.
"""

import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from copperbook.llm.common import numbered, only, stored

SHARDS = 8
LOT_ROWS = 1 << 18
LEAST_LOTS = 48


def random_key(seed: int) -> Column:
    return F.xxhash64(F.rand(seed))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good: inversion outward from
    the mode, in steps of the order of the standard deviation."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    total = _log_choose(good + bad, draws)
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - total)
    u = rng.random() - p
    down = up = mode
    p_down = p_up = p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], room: list[int], seed: int) -> list[list[int]]:
    """Counts from each lot to each shard; sums of rows are ``sizes``, sums of
    columns ``room``."""
    rng, room, matrix = random.Random(seed), list(room), []
    for size in sizes:
        row, rest, left = [], sum(room), size
        for shard, free in enumerate(room):
            rest -= free
            took = hypergeometric(rng, free, rest, left)
            room[shard] -= took
            left -= took
            row.append(took)
        matrix.append(row)
    return matrix


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (0, 1, 2, ... in each shard)."""
    keyed = df.select(
        "*", random_key(seed).alias("__one"), random_key(seed + 1).alias("__two"), random_key(seed + 2).alias("__three")
    )
    keyed = stored(keyed, "keyed")
    rows = keyed.count()
    lots = max(LEAST_LOTS, -(-rows // LOT_ROWS))
    keyed = keyed.withColumn("__lot", F.floor((F.col("__one") / F.lit(2.0**64) + 0.5) * lots).cast("int"))
    counts = {r["__lot"]: r["count"] for r in keyed.groupBy("__lot").count().collect()}
    sizes = sorted(counts.items())
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in sizes], room, seed)
    ends = [
        {"at": lot, "ends": [sum(row[: k + 1]) for k in range(shards)]} for (lot, _), row in zip(sizes, matrix)
    ]
    drawn = df.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<at:int,ends:array<long>>>"))
    )
    place = F.row_number().over(Window.partitionBy("__lot").orderBy("__two")) - 1
    dealt = (
        keyed.withColumn("__place", place)
        .join(drawn, F.col("__lot") == F.col("at"))
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("__place"))).cast("int"))
        .drop("__one", "__two", "__lot", "__place", "at", "ends")
    )
    dealt = stored(dealt, "dealt")
    return numbered(dealt, "slot", ["shard"], [F.col("__three")], max(8, lots // shards)).drop("__three")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: id, size, CRC-32 of the text, and where it goes."""
    plain = only(docs, id_col, text_col).toDF("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    slim = plain.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
    )
    return shard_rows(slim, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
