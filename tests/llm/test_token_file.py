"""Token files: exact round trips, damage, and ids against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from copperbook.llm import range_coder as rc
from copperbook.llm import token_file as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 9000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (
        rng.integers(0, 1 << 16, n),
        np.full(n, 65535),
        rng.zipf(1.3, n) % 50257,
        np.tile(rng.integers(0, 50000, 37), n // 37 + 1)[:n],
    ):
        assert (rc.decode(b"".join(rc.encode(ids))) == ids).all()


def test_repetition_costs_little():
    ids = np.tile(np.arange(1000, 1050), 400)
    assert sum(map(len, rc.encode(ids))) < len(ids) / 4


def test_ids_cost_less_than_by_their_frequencies():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 50000, k % 3 + 1) for k in range(3000)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.2, 60000) % 3000])
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    entropy = -(share * np.log2(share)).sum()
    assert 8 * sum(map(len, rc.encode(ids))) / len(ids) < 0.9 * entropy


@pytest.mark.parametrize("n", [63, 64, 65, 127, 129, 4096, 16384, 16385, 40000])
def test_strands_of_any_length(n):
    ids = np.random.default_rng(n).zipf(1.2, n) % 50257
    for block in (100, 5000, rc.BLOCK):
        assert (rc.decode(b"".join(rc.encode(ids, block))) == ids).all()


def test_blocks_stand_alone():
    ids = np.random.default_rng(1).zipf(1.4, 5000) % 50257
    blocks = rc.encode(ids, block=1024)
    assert len(blocks) == 5
    parts = [rc.decode(b) for b in blocks]
    assert (np.concatenate(parts) == ids).all()
    assert (rc.decode(b"".join(blocks[::-1])) == np.concatenate(parts[::-1])).all()


def test_damage_is_noticed():
    data = bytearray(b"".join(rc.encode(np.arange(3000) % 977)))
    data[40] ^= 1
    with pytest.raises(ValueError):
        rc.decode(bytes(data))
    with pytest.raises(ValueError):
        rc.decode(bytes(data[:-1]))


def test_words_give_the_ids_of_whole_texts():
    rng, encoder, tokenizer = random.Random(1), tf.Encoder(PATH), Tokenizer.from_file(PATH)
    alphabet = "ab'st lldrev  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0éñß²¼ª0129.,!-_中Ω😀"
    some = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)] + ["a <|endoftext|> b"]
    for text, ids in zip(some, encoder.encode(some)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def wanted(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [tf.END_ID]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in tf.read(tf.write(docs, PATH)).collect()) == wanted(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, None, 0), (2, "", 0)], "doc_id long, text string, part int")
    rows = [(None, None), (1, "a b"), (1, "a b"), (2, "")]
    found = sorted((tuple(r) for r in tf.read(tf.write(df, PATH)).collect()), key=lambda r: r[1])
    assert found == wanted(rows)
    assert tf.read(tf.write(df.limit(0), PATH)).count() == 0


def test_strands_share_what_they_learn():
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 50000, k % 3 + 1) for k in range(30000)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.1, 1 << 20) % 30000])
    whole = sum(map(len, rc.encode(ids)))
    assert whole < 0.98 * sum(map(len, rc.encode(ids, 1 << 18)))


def test_carries_pass_through_full_words():
    full = (1 << 32) - 1
    words = np.array([[7, 1], [full, 2], [full, 3], [5, 4]], np.uint32)
    moved = np.array([[1, 1], [1, 0], [1, 1], [1, 1]], bool)
    carried = np.array([[0, 0], [0, 0], [0, 1], [1, 0]], bool)
    flat, sizes = rc._settled(words, moved, carried)
    assert flat.tolist() == [8, 0, 0, 5, 2, 3, 4]
    assert sizes.tolist() == [4, 3]


def test_any_damage_of_a_block_is_noticed():
    data = b"".join(rc.encode(np.random.default_rng(6).zipf(1.3, 900) % 50257))
    for at in range(4, len(data), 7):  # behind the number of ids
        bad = bytearray(data)
        bad[at] ^= 0x55
        try:
            found = rc.decode(bytes(bad))
        except ValueError:
            continue
        assert (found == rc.decode(data)).all()  # the last bits of a strand may be any


def test_words_of_neighbours_stay_apart():
    encoder, tokenizer = tf.Encoder(PATH), Tokenizer.from_file(PATH)
    some = ["a'", "s b", " ", "c", "", "x ", "\n", "\n'll", "'", "re", "d'l", "l", "'t's 't!'m", "中", "12", "3 ", "4", ""]
    rng = random.Random(8)
    for _ in range(200):
        rng.shuffle(some)
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([]) == []
    assert [len(x) for x in encoder.encode(["", ""])] == [0, 0]


def test_words_go_once_through_the_model(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 3)
    encoder = tf.Encoder(PATH)
    encoder._tokenizer = None  # its steps before and after the model are not needed
    asked, pairs = [], encoder._pairs

    class Asked:
        def tokenize(self, word):
            asked.append(word)
            return pairs.tokenize(word)

    encoder._pairs = Asked()
    first = encoder.encode(["one two three four", "one two"])
    assert asked == ["one", "Ġtwo", "Ġthree", "Ġfour"]
    again = encoder.encode(["one two five"])  # the words known before are not forgotten at once
    assert asked[4:] == ["Ġfive"]
    assert again[0][:2].tolist() == first[1].tolist()
    assert len(encoder._known) == 3 and len(encoder._earlier) == 4
