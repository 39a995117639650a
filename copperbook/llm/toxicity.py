"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled are a draw from all
texts, so that toxic ones are among them at the prior's share. With prior p, positive loss R_p+,
positive-as-negative loss R_p- and unlabelled loss R_u-, the risk is
``p R_p+ + max(0, R_u- - p R_p-)``. A linear model over words is fitted in numpy
on the driver, by full gradient steps with the logistic loss; where the corrected negative risk falls below zero the step goes
up that part instead, as the estimator asks.

Bounds, stated as parameters: ``most_positive`` positives and ``most_unlabelled``
unlabelled rows are drawn by the hash of the id from the rows that may be
learned from; ``most_words`` words that occur in the positives and lean to them
make up the vocabulary. Everything else covers all rows: each text is scored
whole, by the set of its words and of their beginnings.

Labels are learned only from rows whose CRC-32 of the id modulo 5 is not 0. Ids,
labels, language and source are no input of a score.

Rows: null and empty texts have no words and get the score of the bias; a null
id counts as the text '' for the fold; repeated rows get equal scores; labels
that are null or unmatched are no labels; without positives the model has no
words and calls nothing toxic; an empty table gives an empty result. Extra
columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import only, stored, texts, utf8

FOLDS = 5
MOST_POSITIVE = 3000
MOST_UNLABELLED = 6000
MOST_WORDS = 4000
LEAST_DOCS = 5
LEAST_LEAN = 6.0
LEAST_PURE = 0.5
STEMS = (4, 5, 6)

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(body: bytes) -> set[bytes]:
    """The features of a text: its distinct runs of letters and digits, ASCII
    letters lowered; their beginnings, so that forms of a stem count together;
    and the beginnings that two or more of them share."""
    whole = set(_WORD.findall(body.lower()))
    starts = Counter([w[:n] for n in STEMS for w in whole if len(w) > n])
    return whole | {b"^" + s for s in starts} | {b"^^" + s for s, n in starts.items() if n > 1}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    """Weights of words and a bias."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -1.0

    def score(self, body: bytes) -> float:
        get = self.weights.get
        z = self.bias + sum(sorted(w for w in map(get, words(body)) if w is not None))
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def fit(
    vocabulary: list[bytes],
    positive: list[list[int]],
    unlabelled: list[list[int]],
    prior: float,
    steps: int = 1500,
    rate: float = 0.05,
    penalty: float = 1e-4,
) -> Model:
    """Minimise the non-negative risk with Adam; words weigh by presence. The
    rows hold places in the vocabulary."""
    if not positive:
        return Model()

    def rows(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(f) for f in found], np.int64)
        return np.repeat(np.arange(len(found)), lengths), np.array([k for f in found for k in f], np.int64)

    (p_row, p_col), (u_row, u_col) = rows(positive), rows(unlabelled)
    n_p, n_u = len(positive), max(1, len(unlabelled))
    w, b = np.zeros(len(vocabulary) + 1), 0.0
    first, second = np.zeros_like(w), np.zeros_like(w)

    def logits(row, col, n):
        return w[-1] + np.bincount(row, w[col], n)[:n]

    def gradient(row, col, slope):
        out = np.empty_like(w)
        out[:-1] = np.bincount(col, slope[row], len(vocabulary))
        out[-1] = slope.sum()
        return out

    for step in range(1, steps + 1):
        z_p, z_u = logits(p_row, p_col, n_p), logits(u_row, u_col, n_u)
        s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        toward = prior * gradient(p_row, p_col, (s_p - 1) / n_p)
        away = gradient(u_row, u_col, s_u / n_u) - prior * gradient(p_row, p_col, s_p / n_p)
        g = toward + away if negative >= 0 else -away
        g[:-1] += penalty * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({x: float(v) for x, v in zip(vocabulary, w) if abs(v) > 1e-4}, float(w[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
    most_words: int = MOST_WORDS,
) -> Model:
    """Fit on bounded draws from the folds that may be learned from. Without a
    ``prior`` it is the share of positives among their labelled rows."""
    plain = only(docs, id_col, text_col).toDF("doc_id", "text").where(~held_out(F.col("doc_id")))
    marks = (
        only(labels, id_col, label_col).toDF("doc_id", "toxic")
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not counts["p"]:
        return Model()
    prior = prior if prior is not None else min(0.5, max(0.01, counts["p"] / counts["n"]))
    def drawn(ids: DataFrame, most: int, positive: bool) -> DataFrame:
        chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)
        rows = plain.join(F.broadcast(chosen), "doc_id").select(F.lit(positive).alias("positive"), utf8("text").alias("body"))
        return rows.dropDuplicates(["body"])  # copies of a text count once

    toxic = marks.where("toxic = 1")
    anyone = plain.select("doc_id").where("doc_id is not null")
    draw = stored(drawn(toxic, most_positive, True).unionByName(drawn(anyone, most_unlabelled, False)), "draw")
    n = dict(draw.groupBy("positive").count().collect())
    vocabulary = _vocabulary(draw, n.get(True, 0), n.get(False, 0), prior, most_words)
    rows = draw.select("positive", "body").mapInArrow(_places(vocabulary), "positive boolean, places array<int>").collect()
    rows = sorted((r["positive"], r["places"]) for r in rows)
    return fit(vocabulary, [x for p, x in rows if p], [x for p, x in rows if not p], prior)


def _vocabulary(draw: DataFrame, n_p: int, n_u: int, prior: float, most: int) -> list[bytes]:
    """Words of at least ``LEAST_DOCS`` positives whose share there is beyond
    their share in the unlabelled by ``LEAST_LEAN`` standard errors, and of whose
    unlabelled texts the prior makes ``LEAST_PURE`` positive; the furthest first."""
    if not n_p:
        return []
    n_u = max(1, n_u)
    held = draw.select("positive", "body").mapInArrow(_bags, "positive boolean, word binary")
    counts = held.groupBy("word").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")
    )
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    error = F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    lean = F.when(error > 0, (F.col("p") / n_p - F.col("u") / n_u) / error).otherwise(0.0)
    found = counts.where(F.col("p") >= LEAST_DOCS).withColumn("lean", lean).where(F.col("lean") >= LEAST_LEAN)
    found = found.where(F.lit(prior / n_p) * F.col("p") >= F.lit(LEAST_PURE / n_u) * F.col("u"))
    return [bytes(r["word"]) for r in found.orderBy(F.desc("lean"), "word").limit(most).collect()]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for flags, bodies in texts(batches, 1 << 20):
        pairs = [(f, w) for f, b in zip(flags, bodies) for w in words(b)]
        yield pa.record_batch(
            {"positive": pa.array([f for f, _ in pairs], pa.bool_()), "word": pa.array([w for _, w in pairs], pa.binary())}
        )


def _places(vocabulary: list[bytes]):
    at = {w: k for k, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flags, bodies in texts(batches, 4 << 20):
            found = [sorted(at[w] for w in words(b) if w in at) for b in bodies]
            yield pa.record_batch({"positive": pa.array(flags, pa.bool_()), "places": pa.array(found, pa.list_(pa.int32()))})

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in texts(batches, 4 << 20):
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "score": pa.array([float(model.score(b)) for b in bodies], pa.float64())})

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    plain = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    scored = plain.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns as they were."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score((t or "").encode()) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(np.array(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
