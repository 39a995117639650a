"""Whitening of embeddings along their principal components.

Entries become whole numbers (``STEP`` a unit), so counts, sums and deviations
are exact. Tasks add up sums, then products of centred vectors; Spark adds the
partial sums of the tasks, and a matrix of dimension by dimension reaches the
driver, whose size does not depend on the rows. There ``feast.largest`` extracts
the components, and tasks project every row.

Rows: a vector that is null, empty, or has a null or non-finite entry or one of
2**40 or more is left out; so is one whose length is not that of most others (of
equally frequent lengths the greater stands). Null ids stay, repeated rows count
each time. Components at rounding level are no components: n equal vectors, or
one, give no rows, nor does an empty table. A deviation above the largest long
is null. Extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperbook.llm import feast
from copperbook.llm.common import only, stored

STEP, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries from here on have no exact place among the whole numbers.
TOO_LARGE = 2.0**40
_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as longs, of the vectors that count; stored."""
    plain = only(df, id_col, vector_col).toDF("vec_id", "v")
    plain = plain.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    # comparisons with null or not-a-number: abs(NaN) sorts above every number
    good = plain.where("size(v) > 0").where(
        F.forall("v", lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False)))
    )
    made = good.select("vec_id", F.transform("v", lambda c: F.floor(c * STEP) + F.lit(OFFSET)).alias("x"))
    made = stored(made, "whole-numbers")
    usual = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return made.where(F.size("x") == (usual.d if usual else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch)  # entries are below 2**47, so 2**15 rows add up in a long
        for at in range(0, len(x), 1 << 15):
            part = x[at : at + (1 << 15)].sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, part)] if total else part
    if total:
        kind = pa.decimal128(38, 0)
        yield pa.record_batch({"i": pa.array(range(len(total)), pa.int32()), "part": pa.array(total, kind)})


class _Centre:
    """The exact mean S/n as a whole number and a rest of at most one half."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        whole = [(2 * s + n) // (2 * n) for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = np.array([(s - n * w) / n for s, w in zip(sums, whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        far = np.abs(x - self.whole).max(initial=0) + 1
        if (float(far) * self.n) ** 2 * x.shape[1] < 2.0**62:
            rest = np.array([s - self.n * int(w) for s, w in zip(self.sums, self.whole)], np.int64)
            apart = self.n * (x - self.whole) - rest
            return (apart * apart).sum(axis=1).tolist()
        out = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in out]


def _centre(x: DataFrame) -> _Centre | None:
    n = x.count()
    if not n:
        return None
    sums = x.select("x").mapInArrow(_sums, "i int, part decimal(38,0)").groupBy("i").agg(F.sum("part").alias("s"))
    return _Centre(n, [int(r.s) for r in sums.orderBy("i").collect()])  # a row per dimension


def covariance(x: DataFrame, centre: _Centre, turn: np.ndarray | None = None) -> np.ndarray:
    """Of the centred vectors, or of their products with ``turn``; divisor n."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = centre.centred(_matrix(batch))
            rows = rows if turn is None else rows @ turn
            part = rows.T @ rows
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total))})

    cells = x.select("x").mapInArrow(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    found = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # a row per pair of dimensions
    size = len(centre.sums) if turn is None else turn.shape[1]
    out = np.zeros((size, size))
    for r in found:
        out[r.i, r.j] = r.v
    return (out + out.T) / (2 * centre.n)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    x = whole_numbers(df, id_col, vector_col)
    nothing = df.sparkSession.createDataFrame([], _ROWS)
    centre = _centre(x)
    if centre is None:
        return nothing
    spread = covariance(x, centre)
    values, vectors = feast.largest(spread, most)
    if not len(values):
        return nothing
    turn = vectors / np.sqrt(values)
    explained = values / np.trace(spread)
    error = float(np.abs(covariance(x, centre, turn) - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                lot = batch.slice(at, 2048)
                rows = _matrix(lot)
                each = np.repeat(np.arange(len(rows)), k)
                yield pa.record_batch(
                    {
                        "vec_id": lot.column(0).take(pa.array(each)),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        "n": pa.array(np.full(len(each), centre.n, np.int64)),
                        "deviation": pa.array(centre.deviations(rows), pa.int64()).take(pa.array(each)),
                        "whitened": pa.array((centre.centred(rows) @ turn).ravel()),
                        "explained": pa.array(np.tile(explained, len(rows))),
                        "identity_error": pa.array(np.full(len(each), error)),
                    }
                )

    return x.select("vec_id", "x").mapInArrow(project, _ROWS)
