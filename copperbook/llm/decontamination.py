"""Benchmark decontamination by pigeonhole edit matching.

Item and text are normalised to lower-case words with one blank between them.
An item of m characters may differ in m // ``per_error`` edits. It is split
into one piece more than that, so in any occurrence some piece is unharmed. An
Aho-Corasick automaton over all pieces finds exact hits in one pass over a
text; each hit names a diagonal, and Myers' bit-parallel distance checks the
item against the text around it. Hits of one item close together are checked
once.

The items are the small side: they are read in blocks of at most
``block_bytes`` of text, each block is one pass over the documents, and a block
is what a task holds. There is no cap on hits or matches.

Rows: null and empty texts match nothing; items without words are no items;
items too short for an error match as whole words; equal items are each
reported; null ids of documents are kept in hits; repeated rows are each
reported; empty tables give empty results; extra columns are ignored by
``matches`` and kept by ``clean``.
"""

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import only

PER_ERROR = 20
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"\w+")


def normalised(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text``, and the
    first end of such a substring. Myers' bit vectors, one step a character."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(pattern):
        peq[ch] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for at, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a match may begin anywhere
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], per_error: int = PER_ERROR):
        self._items: list[tuple[int, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            plain = normalised(text or "")
            if not plain:
                continue
            errors = len(plain) // per_error
            if not errors:
                plain = f" {plain} "
            number = len(self._items)
            self._items.append((item_id, plain, errors))
            cuts = [k * len(plain) // (errors + 1) for k in range(errors + 2)]
            for low, high in zip(cuts, cuts[1:]):
                pieces[plain[low:high]].append((number, low))
        self._tree = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self._tree.add_word(piece, (len(piece), places))
        if pieces:
            self._tree.make_automaton()
        self._empty = not pieces

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best, then first, occurrence
        of each item; places count characters of the normalised text."""
        if self._empty or not text:
            return []
        plain = f" {normalised(text)} "
        diagonals: dict[int, set[int]] = defaultdict(set)
        for last, (length, places) in self._tree.iter(plain):
            start = last + 1 - length
            for number, offset in places:
                diagonals[number].add(start - offset)
        found = []
        for number, starts in diagonals.items():
            item_id, item, errors = self._items[number]
            best = None
            for low, high in _spans(sorted(starts), errors):
                low, high = max(0, low - errors), min(len(plain), high + len(item) + errors)
                window = plain[low:high]
                at = window.find(item)
                if at >= 0:
                    distance, start, end = 0, low + at, low + at + len(item)
                else:
                    distance, stop = best_end(item, window)
                    if distance > errors:
                        continue
                    _, back = best_end(item[::-1], window[:stop][::-1][: len(item) + errors])
                    start, end = low + stop - back, low + stop
                if best is None or distance < best[1]:
                    best = (item_id, distance, max(0, start - 1), min(len(plain) - 2, end - 1))
            if best:
                found.append(best)
        return sorted(found, key=lambda x: (x[0] is None, x[0] or 0))


def _spans(starts: list[int], errors: int) -> Iterator[tuple[int, int]]:
    """Diagonals at most ``errors`` apart are looked at together."""
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > errors:
            yield low, high
            low = s
        high = s
    yield low, high


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block; a block holds a few MB whatever their number."""
    plain = only(items, id_col, text_col).toDF("item_id", "text").where("text is not null")
    size = plain.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for k in range(blocks):
        yield sorted((tuple(r) for r in plain.where(block == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _hits(items: list[tuple[int, str]], per_error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, per_error)
        for batch in batches:
            rows = [
                (doc, *hit)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for hit in matcher.find(text)
            ]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
            yield pa.record_batch({n: pa.array(c, k) for (n, k), c in zip(kinds, columns)})

    return run


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    per_error: int = PER_ERROR,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document row and item found in it: distance, and the place in
    the normalised text."""
    plain = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    schema = "doc_id long, item_id long, distance int, start long, end long"
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        part = plain.mapInArrow(_hits(block, per_error), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    per_error: int = PER_ERROR,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were."""
    place = docs.columns.index(text_col)

    def without(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, per_error)
            for batch in batches:
                free = [not matcher.find(t) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(np.array(free, bool)))

        return run

    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs
