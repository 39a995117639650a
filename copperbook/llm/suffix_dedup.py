"""Removal of repeated byte strings with a logarithmic index family.

Every byte covered by a string of 100 bytes that also starts earlier (in a
smaller document, or earlier in the same one) goes. The work is split so that
no text meets another:

1. *Sieve.* Each window of 100 bytes is assigned to its anchor (see
   ``byte_windows``), so one suffix in about forty is looked at. Anchors meet by
   gram. A zone equal to an earlier zone goes whole; a gram with one zone needs
   nothing more.
2. *Index family.* The rest, first zones of grams that have several, go to
   buckets with their bytes. A bucket takes them in document order, batch by
   batch. The suffixes of a batch are put in a suffix array, cut at 100 bytes
   and ordered by the fingerprint of those bytes. It is merge-scanned against
   the arrays of earlier batches for matches; arrays of equal size are merged,
   so that n batches leave log n arrays.
3. *Cut.* The spans meet the text once more.

A gram with many zones in one lot of text (a common line with ever new
neighbours) is spread over all buckets: its windows go there one by one, by
their own fingerprint, and a mark tells the sieve. Equal windows and zones of a
lot are put together before anything is shuffled.

Rows: null text is empty; null ids come first; texts under one id are one after
the other by CRC-32; repeated rows are one document and get the same result;
texts below 100 bytes and empty tables lose nothing. Extra columns are ignored.
"""

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperbook.llm.byte_windows import WINDOW, anchors, windows
from copperbook.llm.common import only, stored, texts, utf8

LOT_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
MANY_ZONES = 64
BATCH_WINDOWS = 1 << 15

_SPAN, _REQUEST, _BLOCK = 0, 1, 2
_ENTRY = [("gram", "<u8"), ("zone", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("first", "<i8"), ("count", "<u4")]
_SIEVED = "kind int, doc long, tie long, first long, last long, spread boolean, gram long"
_MARK = 0


def _rows(kind, doc, tie, first, last, spread, gram) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch(
        {
            "kind": pa.array(np.full(n, kind, np.int32)),
            "doc": pa.array(np.asarray(doc, np.int64)),
            "tie": pa.array(np.asarray(tie, np.int64)),
            "first": pa.array(np.asarray(first, np.int64)),
            "last": pa.array(np.asarray(last, np.int64)),
            "spread": pa.array(np.full(n, spread)),
            "gram": pa.array(np.asarray(gram, np.uint64).view(np.int64)),
        }
    )


def _lot_entries(ids: list, ties: list, bodies: list) -> np.ndarray:
    parts = []
    for doc, tie, body in zip(ids, ties, bodies):
        gram, zone, first, last = anchors(np.frombuffer(body, np.uint8))
        part = np.empty(len(gram), _ENTRY)
        part["gram"], part["zone"], part["doc"], part["tie"] = gram, zone, doc, tie
        part["first"], part["count"] = first, last - first + 1
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, _ENTRY)


def _ordered(entries: np.ndarray) -> np.ndarray:
    return entries[np.lexsort((entries["first"], entries["tie"], entries["doc"], entries["zone"], entries["gram"]))]


def _starts(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new gram starts, and where a new zone of a gram starts."""
    gram = np.ones(len(entries), bool)
    gram[1:] = entries["gram"][1:] != entries["gram"][:-1]
    zone = gram.copy()
    zone[1:] |= entries["zone"][1:] != entries["zone"][:-1]
    return gram, zone


def _repeated(entries: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Later zones of each run; a repeated row is not later than itself."""
    lead = entries[np.flatnonzero(starts)[np.cumsum(starts) - 1]] if len(entries) else entries
    same = (entries["doc"] == lead["doc"]) & (entries["tie"] == lead["tie"]) & (entries["first"] == lead["first"])
    return entries[~starts & ~same]


def _as_rows(kind: int, entries: np.ndarray, spread: bool = False) -> pa.RecordBatch:
    last = entries["first"] + entries["count"].astype(np.int64) - 1
    return _rows(kind, entries["doc"], entries["tie"], entries["first"], last, spread, entries["gram"])


def _pack(entries: np.ndarray) -> bytes:
    """Column by column, the small ones as differences, for the codec's sake."""
    entries = entries[np.lexsort((entries["first"], entries["tie"], entries["doc"]))]
    first = entries["first"]
    wide = bool(len(first) and first.max() >= 1 << 32)
    columns = [
        entries["gram"].tobytes(),
        entries["zone"].tobytes(),
        np.diff(entries["doc"], prepend=np.int64(0)).tobytes(),
        np.diff(entries["tie"], prepend=np.int64(0)).tobytes(),
        first.astype("<i8" if wide else "<u4").tobytes(),
        entries["count"].astype("u1").tobytes(),
    ]
    return struct.pack("<IB", len(entries), wide) + b"".join(columns)


def _unpack(data: bytes) -> np.ndarray:
    n, wide = struct.unpack_from("<IB", data)
    out, at = np.empty(n, _ENTRY), 5
    for name, kind in (("gram", "<u8"), ("zone", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("first", "<i8" if wide else "<u4"), ("count", "u1")):
        column = np.frombuffer(data, kind, n, at)
        out[name] = np.cumsum(column) if name in ("doc", "tie") else column
        at += column.nbytes
    return out


def _collect_lots(buckets: int, many: int):
    """Per lot of text: finished spans, requests of spread grams, and a packed
    block of entries for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ties, bodies in texts(batches, LOT_BYTES):
            entries = _ordered(_lot_entries(ids, ties, bodies))
            new_gram, new_zone = _starts(entries)
            finished = _repeated(entries, new_zone)
            entries, new_gram = entries[new_zone], new_gram[new_zone]
            which = np.cumsum(new_gram) - 1
            crowded = np.bincount(which, minlength=1)[which] >= many if len(which) else which > 0
            marks = entries[crowded & new_gram].copy()
            marks["count"] = _MARK
            send = np.concatenate((entries[~crowded], marks))
            bucket = (send["gram"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            send, bucket = send[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blocks = [_pack(x) for x in np.split(send, cuts[1:])] if len(send) else []
            empty = np.zeros(len(blocks), np.int64)
            packed = _rows(_BLOCK, empty, empty, empty, empty, False, empty)
            for rows in (_as_rows(_SPAN, finished), _as_rows(_REQUEST, entries[crowded], True)):
                yield _with_block(rows, rows.column(3).to_numpy() % buckets, [None] * rows.num_rows)
            yield _with_block(packed, bucket[cuts], blocks)

    return run


def _with_block(rows: pa.RecordBatch, bucket: np.ndarray, blocks: list) -> pa.RecordBatch:
    more = [pa.array(bucket, pa.int64()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "bucket", "block"])


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in bucket order; a bucket is settled when the next one starts.
    What the lots have settled passes through."""

    def settle(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate([_unpack(b) for b in blocks])
        marked = np.unique(entries["gram"][entries["count"] == _MARK])
        entries = _ordered(entries[entries["count"] != _MARK])
        new_gram, new_zone = _starts(entries)
        yield _as_rows(_SPAN, _repeated(entries, new_zone))
        entries, new_gram = entries[new_zone], new_gram[new_zone]
        which = np.cumsum(new_gram) - 1
        several = np.bincount(which, minlength=1)[which] > 1 if len(which) else which > 0
        spread = np.isin(entries["gram"], marked)
        yield _as_rows(_REQUEST, entries[spread], True)
        yield _as_rows(_REQUEST, entries[several & ~spread])

    current, held = None, []
    for batch in batches:
        settled = batch.filter(pc.not_equal(batch.column("kind"), _BLOCK))
        yield settled.select(settled.schema.names[:-2])
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
            if block is None:
                continue
            if bucket != current and held:
                yield from settle(held)
                held = []
            current = bucket
            held.append(block)
    if held:
        yield from settle(held)


_ZONES = "bucket long, doc long, tie long, first long, last long, body binary"


def _fetch_zones(buckets: int):
    """The bytes of requested zones; windows of spread grams one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: [] for n in ("bucket", "doc", "tie", "first", "last", "body")}
            for doc, tie, asked, body in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(body, np.uint8)
                for one in asked:
                    first, last = one["first"], one["last"]
                    if one["spread"]:
                        mark, _ = windows(data, first, last)
                        pieces = [(int(m) % buckets, at, at) for m, at in zip(mark, range(first, last + 1))]
                    else:
                        pieces = [((one["gram"] & (1 << 64) - 1) % buckets, first, last)]
                    for bucket, low, high in pieces:
                        for name, value in zip(rows, (bucket, doc, tie, low, high, body[low : high + WINDOW])):
                            rows[name].append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.record_batch({n: pa.array(v, k) for (n, v), k in zip(rows.items(), kinds)})

    return run


class IndexFamily:
    """Suffix arrays of 1, 2, 4, ... batches; two of a size become one."""

    def __init__(self):
        self._levels: list[tuple[np.ndarray, np.ndarray] | None] = []

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Merge-scan: which of the sorted suffixes are in some level?"""
        found = np.zeros(len(one), bool)
        for level in self._levels:
            if level is None:
                continue
            at = np.searchsorted(level[0], one)
            open_ = np.flatnonzero(~found)
            while len(open_):
                open_ = open_[at[open_] < len(level[0])]
                open_ = open_[level[0][at[open_]] == one[open_]]
                hit = level[1][at[open_]] == two[open_]
                found[open_[hit]] = True
                open_ = open_[~hit]
                at[open_] += 1
        return found

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Take the sorted array of a batch, none of which is held."""
        level = (one, two)
        for k, held in enumerate(self._levels):
            if held is None:
                self._levels[k] = level
                return
            both = np.concatenate((held[0], level[0])), np.concatenate((held[1], level[1]))
            order = np.argsort(both[0], kind="stable")  # two sorted runs: a merge
            level = both[0][order], both[1][order]
            self._levels[k] = None
        self._levels.append(level)

    def sizes(self) -> list[int]:
        return [0 if x is None else len(x[0]) for x in self._levels]


def _later(family: IndexFamily, batch: list[tuple]) -> Iterator[tuple]:
    """Spans of windows of a batch, in document order, that occur earlier."""
    marks = [windows(np.frombuffer(body, np.uint8), 0, last - first) for _, _, first, last, body in batch]
    one, two = (np.concatenate([m[k] for m in marks]) for k in (0, 1))
    order = np.lexsort((np.arange(len(one)), two, one))
    one, two = one[order], two[order]
    lead = np.ones(len(one), bool)
    lead[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    held = family.holds(one[lead], two[lead])
    family.add(one[lead][~held], two[lead][~held])
    gone = np.empty(len(one), bool)
    gone[order] = ~lead | held[np.cumsum(lead) - 1]
    at = 0
    for doc, tie, first, last, _ in batch:
        flags = np.concatenate(([False], gone[at : at + last - first + 1], [False])).astype(np.int8)
        edges = np.flatnonzero(np.diff(flags))
        for low, high in zip(edges[::2], edges[1::2]):
            yield doc, tie, first + int(low), first + int(high) - 1
        at += last - first + 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zones by bucket and document order through one index family a bucket."""

    def out(spans: list[tuple]) -> pa.RecordBatch:
        doc, tie, first, last = zip(*spans) if spans else ([],) * 4
        return _rows(_SPAN, doc, tie, first, last, False, np.zeros(len(doc), np.uint64))

    family, current, batch, held, before = IndexFamily(), None, [], 0, None
    for records in batches:
        for bucket, *zone in zip(*(c.to_pylist() for c in records.columns)):
            if (bucket != current or held >= BATCH_WINDOWS) and batch:
                yield out(list(_later(family, batch)))
                batch, held = [], 0
            if bucket != current:
                family, current, before = IndexFamily(), bucket, None
            if zone[:4] == before:  # a repeated row is one document
                continue
            before = zone[:4]
            batch.append(tuple(zone))
            held += zone[3] - zone[2] + 1
    if batch:
        yield out(list(_later(family, batch)))


_DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _runs(spans: list) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs from spans of windows."""
    edge = np.array([(s["first"], s["last"] + WINDOW) for s in spans], np.int64).reshape(-1, 2)
    edge = edge[np.argsort(edge[:, 0], kind="stable")]
    reach = np.maximum.accumulate(edge[:, 1])
    new = np.ones(len(edge), bool)
    new[1:] = edge[1:, 0] > reach[:-1]
    lead = np.flatnonzero(new)
    return edge[lead, 0], reach[np.append(lead[1:], len(edge)) - 1]


def _cut(text_wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, spans, bodies = batch.columns
            digests, kept_texts = [], []
            for asked, body in zip(spans.to_pylist(), bodies.to_pylist()):
                starts, ends = _runs(asked) if asked else ([], [])
                kept, at = [], 0
                for low, high in zip(starts, ends):
                    kept.append(body[at:low])
                    at = high
                kept.append(body[at:])
                rest = b"".join(kept)
                digests.append((len(body), len(body) - len(rest), len(starts), hashlib.sha256(rest).hexdigest()))
                kept_texts.append(rest)
            size, gone, runs, sha = map(list, zip(*digests)) if digests else ([],) * 4
            fields = {
                "doc_id": batch.column(0),
                "n_bytes": pa.array(size, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
            }
            if text_wanted:
                fields["kept"] = pa.array(kept_texts, pa.binary())
            yield pa.record_batch(fields)

    return run


def removal_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many_zones: int = MANY_ZONES
) -> DataFrame:
    """Windows that start earlier too: doc, tie, first and last window start.

    ``doc`` is the id (nulls as the least long), ``tie`` tells texts under one
    id apart: zero where each id has one text, else the CRC-32. ``many_zones`` is
    from where on a gram is spread; it changes no result.
    """
    keyed = _keyed(docs, id_col, text_col)
    total = keyed.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    settled = stored(
        keyed.select("doc", "tie", "body")
        .mapInArrow(_collect_lots(buckets, many_zones), f"{_SIEVED}, bucket long, block binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_sieve, _SIEVED),
        "sieved",
    )
    asked = (
        settled.where(F.col("kind") == _REQUEST)
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("first", "last", "spread", "gram")).alias("asked"))
    )
    zones = (
        keyed.join(asked, ["doc", "tie"])
        .select("doc", "tie", "asked", "body")
        .mapInArrow(_fetch_zones(buckets), _ZONES)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "doc", "tie", "first", "last")
    )
    scanned = stored(zones.mapInArrow(_scan, _SIEVED), "scanned")
    return (
        settled.where(F.col("kind") == _SPAN)
        .unionByName(scanned)
        .select("doc", "tie", "first", "last")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = only(docs, id_col, text_col).toDF("doc_id", "text")
    body = utf8("text")
    several = plain.groupBy("doc_id").agg(
        F.min(F.crc32(body)).alias("low"), F.max(F.crc32(body)).alias("high")
    )
    tied = not several.where("low <> high").isEmpty()
    return plain.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        (F.crc32(body) if tied else F.lit(0)).cast("long").alias("tie"),
        body.alias("body"),
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, many_zones: int = MANY_ZONES
) -> DataFrame:
    """Per row: sizes, runs removed and the digest of what stays; with
    ``with_text`` also the bytes that stay, as ``kept`` (they need not be UTF-8)."""
    spans = (
        removal_spans(docs, id_col, text_col, many_zones)
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )
    joined = _keyed(docs, id_col, text_col).join(spans, ["doc", "tie"], "left")
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, {_DIGEST}" + ", kept binary" * with_text
    return joined.select("doc_id", "spans", "body").mapInArrow(_cut(with_text), schema)


#: Every window by its place: later occurrences cover the bytes that go.
ORACLE = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, n, hex(b) AS h, unnest(range(1, n + 1)) AS i FROM d),
windows AS (
  SELECT doc_id, n, i, substr(h, 2 * i - 1, 2) AS byte,
    CASE WHEN i + 99 <= n THEN substr(h, 2 * i - 1, 200) END AS w FROM places),
starts AS (
  SELECT doc_id, n, i, byte,
    CASE WHEN w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 THEN i END AS gone FROM windows),
covered AS (
  SELECT doc_id, n, i, byte,
    coalesce(max(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 100, false) AS gone FROM starts),
runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM covered),
digests AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN digests USING (doc_id)
"""
