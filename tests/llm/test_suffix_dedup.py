"""Removal of repeated strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np

from copperbook.llm import suffix_dedup as sd
from copperbook.llm.byte_windows import WINDOW, anchors, windows

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - WINDOW + 1):
            piece = data[at : at + WINDOW]
            if piece in seen:
                gone[at : at + WINDOW] = b"\1" * WINDOW
            seen.add(piece)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in sd.remove_repeats(df, **options).collect()), key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)
    assert found(docs, many_zones=2) == brute(rows)


def test_runs_nulls_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [
        (k, "x" * rng.randrange(400) + "ab" * rng.randrange(200) + "é" * rng.randrange(90)) for k in range(40)
    ] + [(None, "x" * 150), (100, None), (101, ""), (102, "y" * WINDOW), (103, "y" * WINDOW)]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, doc int, tie int, body int")
    assert found(df) == brute(rows)


def test_one_id_for_several_texts(spark):
    text = "".join(random.Random(2).choices("abcd ", k=300))
    df = spark.createDataFrame([(1, text), (1, text), (1, "z" + text), (2, text)], "doc_id long, text string")
    rows = found(df)
    assert [r[:3] for r in rows if r[0] == 2] == [(2, 300, 300)]
    # repeated rows agree; of the two texts under id 1 one is kept whole
    assert len({r for r in rows if r[1] == 300 and r[0] == 1}) == 1
    assert {r[2] for r in rows if r[0] == 1} in ({0, 300}, {0, 301})


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_kept_text(spark):
    text = "".join(random.Random(3).choices("abcd ", k=300))
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in sd.remove_repeats(df, with_text=True).collect()}
    assert kept == {1: text.encode(), 2: b"head  tail"}


def test_every_window_has_one_anchor():
    data = np.frombuffer(bytes(random.Random(4).choices(b"ab c", k=700_000)), np.uint8)
    _, _, first, last = anchors(data)
    assert first[0] == 0 and last[-1] == len(data) - WINDOW
    assert (first[1:] == last[:-1] + 1).all()


def test_levels_are_powers_of_two():
    family = sd.IndexFamily()
    rng = np.random.default_rng(0)
    for batch in range(1, 12):
        one = np.sort(rng.integers(0, 1 << 62, 10).astype(np.uint64))
        assert not family.holds(one, one).any()
        family.add(one, one)
        assert family.holds(one, one).all()
        assert family.sizes() == [10 * (1 << k) if batch >> k & 1 else 0 for k in range(len(family.sizes()))]


def test_equal_first_fingerprints_are_told_apart():
    family = sd.IndexFamily()
    one, two = np.array([5, 5], np.uint64), np.array([1, 2], np.uint64)
    family.add(one, two)
    assert family.holds(np.array([5, 5, 5], np.uint64), np.array([1, 2, 3], np.uint64)).tolist() == [True, True, False]


def test_window_fingerprints_tell_windows_apart():
    data = bytes(random.Random(5).choices(b"abc", k=5000))
    one, two = windows(np.frombuffer(data, np.uint8), 0, len(data) - WINDOW)
    pieces = [data[k : k + WINDOW] for k in range(len(one))]
    assert len(set(zip(one.tolist(), two.tolist()))) == len(set(pieces))
