"""Token ids of a corpus in a binary file format, written and read by Spark.

Documents are range-partitioned by id, so that parts, segments of a part and
documents of a segment are in ascending order. A part is written as one row per
segment of about ``SEGMENT_IDS`` ids; a segment holds whole documents and can be
read alone::

    documents, ids                      two 32-bit integers
    per document: id, null flag, ids    64, 8 and 32 bits, as three columns
    CRC-32 of the above                 32 bits
    blocks of the range coder           see ``range_coder``

Places in the corpus are sums over segment sizes: first inside a part, then over
parts, so nothing but a row per part meets in one task.

Texts are encoded with the tokenizers library. Where the file's rule is byte
pairs inside words cut by the usual pattern, the words of a lot of texts are cut
together, as arrays of bytes; each different word goes once through the library's
byte-pair model, and those met of late are remembered, up to twice ``REMEMBERED``.
Texts beyond Latin-1 or with a special token's string are encoded in one piece.
Ids are the same either way.

Rows: null and empty texts hold the end id alone; rows with equal ids follow one
another by a hash of their text; null ids come first; an empty table gives empty
results. Extra columns are ignored.
"""

import functools
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from copperbook.llm.common import only, stored, texts
from copperbook.llm.range_coder import decode, encode

END_ID = 2
SEGMENT_IDS = 4 << 20
LOT_BYTES = 4 << 20
REMEMBERED = 400_000
_HEAD = struct.Struct("<II")

# classes of the usual word pattern, written out for Latin-1
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CLASS = np.zeros(256, np.uint8)
for _kind, _members in (
    (_LETTER, [*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]),
    (_NUMBER, [*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]),
    (_SPACE, [*range(9, 14), 32, 0x85, 0xA0]),
):
    _CLASS[_members] = _kind
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")  # after an apostrophe
# byte pairs work on letters that stand for the bytes
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _PLAIN} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)
}


def word_starts(data: bytes, texts_at: np.ndarray) -> np.ndarray:
    """Where the words of Latin-1 texts start that begin at ``texts_at``: as by
    ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^SLN]+|S+(?!\\S)|S+``."""
    letters = np.frombuffer(data, np.uint8)
    kind = _CLASS.take(letters)
    change = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[texts_at] = True
    same_text = np.ones(len(kind), bool)
    same_text[texts_at] = False
    # the last space before a word stands alone; a blank goes with the word
    space = kind == _SPACE
    after = same_text[1:] & space[:-1] & ~space[1:]
    start = change.copy()
    start[:-1] |= after
    blank = after & (letters[:-1] == 32)
    start[1:] &= ~blank
    # an apostrophe alone and what follows it, unless a blank goes with it
    found = np.flatnonzero((letters[:-1] == 39) & start[:-1] & change[1:] & (kind[1:] == _LETTER) & same_text[1:])
    if len(found):
        bounds = np.append(texts_at, len(data))
        end = bounds[np.searchsorted(bounds, found, "right")].tolist()
        for at, to in zip(found.tolist(), end):
            after_it = data[at + 1 : min(at + 3, to)]
            if ending := next((x for x in _ENDINGS if after_it.startswith(x)), None):
                start[at + 1] = False
                if at + 1 + len(ending) < to:
                    start[at + 1 + len(ending)] = True
    return np.flatnonzero(start)


class Encoder:
    """Texts to ids of two bytes, by the words they share."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rule = json.load(file)
        cut, model = rule.get("pre_tokenizer") or {}, rule["model"]
        self._by_word = (
            rule.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and model.get("type") == "BPE"
            and not any(v for k, v in model.items() if k not in ("type", "vocab", "merges"))
        )
        if self._by_word:
            # words come here once: the model's own memory of them would only cost
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self._pairs = models.BPE(vocab=model["vocab"], merges=pairs, cache_capacity=0)
        self._special = [t["content"] for t in rule.get("added_tokens") or []]
        self._known: dict[bytes, bytes] = {}
        self._earlier: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _plain(self, text: str) -> bytes | None:
        """The text in Latin-1, if it can be cut into words here."""
        if not self._by_word or any(s in text for s in self._special):
            return None
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        if len(self._known) > REMEMBERED:
            self._known, self._earlier = {}, self._known
        known, earlier, tokenize = self._known, self._earlier, self._pairs.tokenize
        found = list(map(known.get, words))
        for k, ids in enumerate(found):
            if ids is None:
                word = words[k]
                if (ids := earlier.get(word)) is None:
                    letters = word.decode("latin-1").encode().decode("latin-1").translate(_LETTERS)
                    ids = array("H", [token.id for token in tokenize(letters)]).tobytes()
                known[word] = found[k] = ids
        return found

    def _words(self, data: bytes, texts_at: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts that follow one another in ``data``."""
        starts = word_starts(data, texts_at[texts_at < len(data)])
        bounds = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        column = column.dictionary_encode()
        which, found = column.indices.to_numpy(), self._of(column.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(found), np.uint16)
        size = np.fromiter(map(len, found), np.int32, len(found)) >> 1
        at = (np.cumsum(size, dtype=np.int32) - size).take(which)
        size = size.take(which)
        ends = np.cumsum(size)
        place = np.repeat(at - (ends - size), size)
        place += np.arange(len(place))
        first = np.searchsorted(starts, texts_at)
        return np.split(ids.take(place), np.append(0, ends)[first[1:]])

    def encode(self, some: list[str]) -> list[np.ndarray]:
        plain = [self._plain(t) for t in some]
        mine = [p for p in plain if p is not None]
        sizes = np.array([len(p) for p in mine], np.int64)
        data = b"".join(mine)
        by_word = iter(self._words(data, np.cumsum(sizes) - sizes) if data else [np.zeros(0, "<u2")] * len(mine))
        return [self._whole(t) if p is None else next(by_word) for t, p in zip(some, plain)]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that tasks find the words of earlier ones.
    A task has one core; the library's threads would take those of others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    sizes = np.array([len(x) for x in ids], "<u4")
    plain = np.array([d or 0 for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], "u1")
    head = _HEAD.pack(len(ids), int(sizes.sum())) + plain.tobytes() + none.tobytes() + sizes.tobytes()
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *encode(np.concatenate(ids))])


def unpack_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    docs, total = _HEAD.unpack_from(data)
    at = _HEAD.size
    plain = np.frombuffer(data, "<i8", docs, at)
    none = np.frombuffer(data, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError("the head of a segment is damaged")
    ids = decode(data[at + 4 :])
    if len(ids) != total:
        raise ValueError("a segment lacks blocks")
    return [None if n else d for d, n in zip(plain.tolist(), none)], np.split(ids, np.cumsum(sizes)[:-1])


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        end = np.array([end_id], "<u2")
        held: tuple[list, list] = ([], [])
        size = seq = 0

        def segment() -> pa.RecordBatch:
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "segment": pa.array([seq], pa.int32()),
                    "n_ids": pa.array([size], pa.int64()),
                    "payload": pa.array([pack_segment(*held)], pa.binary()),
                }
            )

        for docs, bodies in texts(batches, LOT_BYTES):
            for doc, ids in zip(docs, encode(bodies)):
                held[0].append(doc)
                held[1].append(np.concatenate((ids, end)))
                size += len(ids) + 1
            if size >= SEGMENT_IDS:
                yield segment()
                held, size, seq = ([], []), 0, seq + 1
        if held[0]:
            yield segment()

    return run


def write(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder; returns the table of segments.
    ``tokenizer_path`` must exist on every executor."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = only(docs, id_col, text_col).toDF("doc_id", "text")
    plain = plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (
        plain.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    schema = "part int, segment int, n_ids long, payload binary"
    return stored(ordered.mapInArrow(_segments(tokenizer_path, end_id), schema), "token-file")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, segment, payload in zip(*(c.to_pylist() for c in batch.columns)):
            docs, ids = unpack_segment(payload)
            sizes = np.array([len(x) for x in ids], np.int64)
            yield pa.record_batch(
                {
                    "doc_id": pa.array(docs, pa.int64()),
                    "part": pa.array(np.full(len(docs), part, np.int32)),
                    "segment": pa.array(np.full(len(docs), segment, np.int32)),
                    "place": pa.array(np.cumsum(sizes) - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                }
            )


def read(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    sizes = segments.select("part", "segment", "n_ids")
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("__ids"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = parts.select("part", F.coalesce(F.sum("__ids").over(over), F.lit(0)).alias("__part_start"))
    starts = sizes.select(
        "part", "segment", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("__segment_start")
    ).join(parts, "part")
    rows = segments.select("part", "segment", "payload").mapInArrow(
        _documents, "doc_id long, part int, segment int, place long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "segment"]).select(
        "doc_id",
        (F.col("__part_start") + F.col("__segment_start") + F.col("place")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
