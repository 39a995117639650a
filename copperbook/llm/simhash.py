"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits; two documents link when at most ``budget`` bits
differ. The fingerprint is cut into 16 segments on a ring. If the differences
of all segments stay within the budget, some segment starts a chain in which
every k consecutive segments together differ in at most k * budget / 16 bits.
So for each of the 16 starts:

* the first segments, whose share of the budget is below one, must be equal;
* the chain up to a share below two may differ in one bit, so one half of its
  second part must be equal as well. This gives two keys a start, of 30 bits
  for a budget of 3: longer than equal pieces alone allow;
* pairs that meet on a key go through the budget of each longer chain and only
  then to the full Hamming check.

Only distinct fingerprints meet, so copies cost one row. Inside a key, pairs are
compared in numpy and only a star per connected part leaves the task, never all
pairs. A key with very many fingerprints is settled by masks instead: two
fingerprints within the budget agree once the differing bits are masked, so one
sort a mask finds every link in linear space.

Rows: null and empty texts have fingerprint zero and link like others; null ids
are kept and never name a component; repeated rows share their component; an
empty table gives an empty result. Extra columns are ignored.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import only, stored, texts, utf8
from copperbook.llm.components import components

BITS = 64
SEGMENTS = 16
BUDGET = 3
SHINGLE = 3
#: From here on a key is settled by masks; both ways find the same links.
MASKS_FROM = 1 << 16


def fingerprint(body: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """A bit is set if set in over half the hashes of the word shingles."""
    words = body.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(line, seed)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        hashes = b"".join(
            [digest(line[a:b], seed) for a, b in zip([0, *ends], [e - 1 for e in ends[shingle - 1 :]])]
        )
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    set_ = 2 * bits.sum(axis=0, dtype=np.int32) > len(bits)
    return int.from_bytes(np.packbits(set_).tobytes(), "big")


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, bodies in texts(batches, 4 << 20):
            marks = np.array([fingerprint(b, shingle) for b in bodies], np.uint64)
            kept = {"doc_id": pa.array(ids, pa.int64()), "text_key": pa.array(keys, pa.binary())}
            yield pa.record_batch({**kept, "mark": pa.array(marks.view(np.int64))})

    return run


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, text_key, mark): 128 bits of the text, and the fingerprint as a signed long."""
    plain = only(docs, id_col, text_col).toDF("doc_id", "text")
    plain = plain.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _text_key(F.col("text")).alias("text_key"),
        utf8("text").alias("body"),
    )
    return plain.mapInArrow(_fingerprints(shingle), "doc_id long, text_key binary, mark long")


def _turned(marks: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return marks
    return (marks << np.uint64(bits)) | (marks >> np.uint64(BITS - bits))


def _chains(budget: int) -> list[tuple[int, int]]:
    """(segments, differences allowed): the longest chain of each allowance."""
    longest = {k * budget // SEGMENTS: k for k in range(1, SEGMENTS + 1)}
    return [(k, allowed) for allowed, k in sorted(longest.items())]


def _layout(budget: int) -> tuple[int, int, int]:
    """Bits in the equal part, and in the two halves after it."""
    width = BITS // SEGMENTS
    chains = _chains(budget)
    equal = chains[0][0] * width if chains[0][1] == 0 else 0
    reach = (chains[1][0] if len(chains) > 1 and chains[1][1] == 1 else chains[0][0]) * width
    half = (reach - equal) // 2
    return equal, half, reach - equal - half


def _keys(budget: int):
    equal, left, right = _layout(budget)
    width = BITS // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy().view(np.uint64)
            for start in range(SEGMENTS):
                ring = _turned(marks, start * width)
                head = ring >> np.uint64(BITS - equal) if equal else np.zeros_like(ring)
                one = (ring >> np.uint64(BITS - equal - left)) & np.uint64((1 << left) - 1)
                two = (ring >> np.uint64(BITS - equal - left - right)) & np.uint64((1 << right) - 1)
                for half, bits, tail in ((0, left, one), (1, right, two)):
                    key = (((head << np.uint64(bits)) | tail) << np.uint64(5)) | np.uint64(2 * start + half)
                    yield pa.record_batch({"key": pa.array(key.view(np.int64)), "mark": pa.array(marks.view(np.int64))})

    return run


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the parts of a[i] and b[i], in place; every parent is a root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _linked(marks_a: np.ndarray, marks_b: np.ndarray, start: np.ndarray, budget: int) -> np.ndarray:
    """Pigeonring: budgets of ever longer chains from the start of the key; the
    last chain is the whole ring, which is the full check."""
    width = BITS // SEGMENTS
    turn = (start * width).astype(np.uint64)
    unlike = marks_a ^ marks_b
    ring = (unlike << turn) | np.where(turn > 0, unlike >> ((np.uint64(BITS) - turn) % np.uint64(BITS)), np.uint64(0))
    alive = np.ones(len(ring), bool)
    for segments, allowed in _chains(budget):
        part = ring >> np.uint64(BITS - segments * width)
        alive &= np.bitwise_count(part) <= allowed
    return alive


def _masked(parent: np.ndarray, rows: np.ndarray, marks: np.ndarray, budget: int) -> None:
    """Links of the rows of one key: agreement once up to ``budget`` bits are masked."""
    spread = int(np.bitwise_or.reduce(marks[rows] ^ marks[rows[0]]))
    places = [b for b in range(BITS) if spread >> b & 1]
    for chosen in combinations(places, min(budget, len(places))):
        mask = np.uint64(~sum(1 << b for b in chosen) & (1 << BITS) - 1)
        left = marks[rows] & mask
        order = np.argsort(left, kind="stable")
        same = np.flatnonzero(left[order][1:] == left[order][:-1])
        _joined(parent, rows[order[same]], rows[order[same + 1]])


def _links(budget: int, masks_from: int):
    """Rows in key order; each lot of whole keys gives a star per linked part."""

    def settle(keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(marks, return_inverse=True)
        parent = np.arange(len(nodes))
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(edge, len(keys)))
        for k in np.flatnonzero(size >= masks_from):
            _masked(parent, at[edge[k] : edge[k] + size[k]], nodes, budget)
        size = np.where(size >= masks_from, 0, size)
        length = np.diff(np.append(edge, len(keys)))
        left = np.repeat(size, length) - (np.arange(len(keys)) - np.repeat(edge, length))
        start = (keys & 31) >> 1
        active = np.flatnonzero(left > 1)
        for step in range(1, int(size.max(initial=1))):
            active = active[left[active] > step]
            a = active[parent[at[active]] != parent[at[active + step]]]
            a = a[_linked(marks[a], marks[a + step], start[a], budget)]
            _joined(parent, at[a], at[a + step])
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.record_batch(
            {"a": pa.array(nodes[child].view(np.int64)), "b": pa.array(nodes[parent[child]].view(np.int64))}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            marks = np.concatenate((marks, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) > 1 << 18 and keys[0] != keys[-1]:
                whole = np.searchsorted(keys, keys[-1])
                yield settle(keys[:whole], marks[:whole])
                keys, marks = keys[whole:], marks[whole:]
        if len(keys):
            yield settle(keys, marks)

    return run


def mark_links(marks: DataFrame, budget: int = BUDGET, masks_from: int = MASKS_FROM) -> DataFrame:
    """From distinct marks(mark) to links(a, b) that connect what is linked."""
    return (
        marks.select("mark")
        .mapInArrow(_keys(budget), "key long, mark long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_links(budget, masks_from), "a long, b long")
    )


def mark_components(marks: DataFrame, budget: int = BUDGET, masks_from: int = MASKS_FROM) -> DataFrame:
    """From distinct marks(mark) to (mark, root); a mark without links is its own root."""
    return _rooted(marks, mark_links(marks, budget, masks_from))


def _rooted(marks: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select(F.col("a").alias("mark"), F.col("b").alias("root"))
    return marks.select("mark").join(roots, "mark", "left").select("mark", F.coalesce("root", "mark").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    budget: int = BUDGET,
    masks_from: int = MASKS_FROM,
) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id (least id of its component),
    class_size (rows with the same fingerprint), root of the component, text_key."""
    each = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    names = each.groupBy("mark").agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size"))
    rooted = names.join(_rooted(names, mark_links(names, budget, masks_from)), "mark")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("mark", "component_id", "root", "class_size")
    return each.join(named, "mark").select(
        "doc_id",
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"),
        "component_id",
        "class_size",
        "root",
        "text_key",
    )


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    budget: int = BUDGET,
) -> DataFrame:
    """The rows of ``docs`` less later members of a component. The row with the
    least id stays; among rows under that id, or where no row has an id, the one
    with the least hash of its text, once. Columns are as they were."""
    found = near_duplicates(docs, id_col, text_col, shingle, budget)
    stay = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy(F.col("doc_id").alias("__id"), "root")
        .agg(F.min("text_key").alias("__key"))
        .select("__id", "__key")
        .distinct()
    )
    keyed = docs.withColumn("__text", _text_key(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    kept = keyed.join(stay, same, "left_semi").dropDuplicates([id_col, "__text"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
