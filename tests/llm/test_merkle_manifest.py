"""The manifest against trees built by hand."""

import hashlib
import zlib

import pytest

from copperbook.llm import merkle_manifest as mm
from copperbook.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    shown = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, pos):
    for level in tree[:-1]:
        yield pos % 2, (level[pos ^ 1] if pos ^ 1 < len(level) else None)
        pos //= 2


def by_hand(rows):
    order = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted([r for r in rows if r[2] == lang], key=lambda r: (order(r[0]) if r[0] is not None else (False, 0), leaf(r)))
        trees[lang] = (own, levels([leaf(r) for r in own]))
    top = levels([trees[lang][1][-1][0] for lang in langs])
    root = top[-1][0]
    out = []
    for at, lang in enumerate(langs):
        own, tree = trees[lang]
        for pos, row in enumerate(own):
            wrong = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded, proof = leaf(row, int(wrong)), []
            for is_right, sibling in [*path(tree, pos), *path(top, at)]:
                if sibling is None:
                    folded = sha(folded)
                    continue
                proof.append(sibling)
                folded = sha(sibling, folded) if is_right else sha(folded, sibling)
            out.append((row[0], leaf(row), tree[-1][0], root, sha(*proof), folded, folded == root))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted(map(tuple, mm.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


ODD = [
    (5, "five", "en", "web", 4),
    (5, "five", "en", "web", 4),
    (5, "other", "en", None, 4),
    (None, "no id", "en", "web", 5),
    (None, "no id", None, "web", 5),
    (7, None, None, None, None),
    (9, "", "", "", 0),
    (10, "é" * 70_000, "zz", "web", 70_000),
    (11, "max", "é", "web", 2**63 - 1),
    (-3, "minus", "Z", "web", -1),
]


@pytest.mark.parametrize("span", [1, 2, 10])
def test_odd_rows_and_sizes(spark, monkeypatch, span):
    monkeypatch.setattr(mm, "SPAN", span)
    monkeypatch.setattr(mm, "WIDTH", 1 << span)
    many = [(i, f"text {i}", "en" if i % 3 else f"l{i % 5}", "web", i) for i in range(100, 147)]
    rows = ODD + many
    assert got(spark, rows) == by_hand(rows)


def test_one_row(spark):
    rows = [(7, "only", "en", "web", 4)]
    assert got(spark, rows) == by_hand(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_extra_columns_and_setting(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    plain = spark.createDataFrame(ODD, SCHEMA)
    extra = plain.selectExpr("*", "'x' AS tree", "1 AS pos", "2 AS n", "'y' AS leaf", "3 AS level")
    found = sorted(map(tuple, mm.manifest(extra).collect()), key=str)
    assert found == by_hand(ODD)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_tampering_is_found(spark, sf_dir):
    found = mm.manifest(table(spark, sf_dir, "documents")).collect()
    wrong = {r.doc_id for r in found if not r.verified}
    assert wrong == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
