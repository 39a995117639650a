"""Viterbi against all state sequences; roles of made transcripts."""

import itertools
import random

import numpy as np

from copperbook.llm import chat as ch


def model_from(rng):
    counts = {}
    for kind, rows, columns in (("move", 8, 8), ("start", 1, 8), ("marker", 8, 5), ("length", 8, 7), ("end", 8, 4)):
        for r, c in itertools.product(range(rows), range(columns)):
            counts[kind, r, c] = rng.randrange(20)
    return ch.Model.counted(counts)


def weight(model, states, lines):
    total = model.start[states[0]]
    for a, b in itertools.pairwise(states):
        total += model.move[a, b]
    return total + sum(model.marker[s, m] + model.length[s, n] + model.end[s, e] for s, (m, n, e, _) in zip(states, lines))


def test_viterbi_finds_the_likeliest_states():
    rng = random.Random(1)
    for _ in range(20):
        model = model_from(rng)
        lines = [(rng.randrange(5), rng.randrange(7), rng.randrange(4), "") for _ in range(4)]
        best = max(weight(model, s, lines) for s in itertools.product(range(8), repeat=4))
        assert np.isclose(weight(model, model.states(lines), lines), best)


def test_markers():
    for text, role in {
        "User: hi": "user", "  ASSISTANT : hi": "assistant", "### Response:": "assistant", "**Human**: x": "user",
        "[system] x": "system", "<|tool|>": "tool", "Q: why?": "user", "A> because": "assistant",
    }.items():
        assert ch.ROLES[ch.read_line(text)[0]] == role, text
    for text in ("Aside: hi", "the user: hi", "User hi", "ai://host", "#hashtag", ""):
        assert ch.read_line(text)[0] == 4, text


def test_turns_and_canonical_form():
    model = ch.Model.counted({})
    text = "System: be kind\nUser: hello\nsecond line?\n\nAssistant: hi\nmore.\nUser: bye"
    goes_on, turns = model.turns(text)
    assert not goes_on and turns == [("system", "be kind"), ("user", "hello\nsecond line?"), ("assistant", "hi\nmore."), ("user", "bye")]
    assert ch.render(turns[:1]) == "<|system|>\nbe kind\n<|end|>\n"
    assert model.turns(None) == (False, []) and model.turns("") == (False, [])


def test_roles_are_recovered(spark, sf_dir):
    rows = ch.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    assert sum(r["roles_right"] for r in rows) / len(rows) >= 0.6  # 16 conversations to learn from
    assert all(r["n_turns"] == len(r["roles"].split(",")) for r in rows)


def test_learned_roles_beat_the_untaught_model(spark):
    rng, rows = random.Random(2), []
    for conv in range(300):
        for turn in range(6):
            user = turn % 2 == 0
            words = rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(3, 9) if user else rng.randrange(60, 120))
            rows.append((conv, turn, "user" if user else "assistant", " ".join(words) + ("?" if user else ".")))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = [r["roles_right"] for r in ch.format_conversations(df).collect() if r["held_out"]]
    assert sum(held) / len(held) > 0.95


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, lines int, stretch int"
    rows = [(1, 0, None, None, 0, 0), (None, 0, "user", "hi", 0, 0), (1, 1, "user", "x", 0, 0), (1, 1, "user", "x", 0, 0), (2, None, "odd", "a\nb", 0, 0)]
    found = ch.format_conversations(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r["conv_id"]) for r in found) == ["1", "2", "None"]
    assert ch.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_long_conversations_are_cut_into_stretches(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(1100)]
    found = ch.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["stretch"] for r in found) == [0, 1, 2]
    assert sum(r["rendered"].count("t") > 0 for r in found) == 3


SCHEMA = "conv_id long, turn long, role string, text string"


def odd_conversations(rng):
    """Few markers, turns of several lines, blanks; null conversations and turns."""
    rows = []
    for conv, n in ((1, 90), (2, 7), (3, 23), (None, 41), (4, 8), (5, 9), (6, 1)):
        for k in range(n):
            lines = [" ".join(rng.choices(["a", "b", "c?", "d."], k=rng.randrange(9))) for _ in range(rng.randrange(1, 4))]
            rows.append((conv, rng.choice([None, k, k // 3]), rng.choice(ch.ROLES), "\n".join(lines)))
    return rows


def test_cut_conversations_get_the_states_of_whole_ones(spark):
    rng = random.Random(4)
    for fan in (2, 3, 512):
        model = model_from(rng)
        df = spark.createDataFrame(odd_conversations(rng), SCHEMA)
        parts = ch.stored(ch.transcripts_of(df, stretch=4), "test")
        ends = {(r[0], r[1]): (r[2], r[3]) for r in ch.ends_of_stretches(parts, model, fan).collect()}
        stretches = {}
        for r in parts.collect():
            stretches.setdefault(r["conv_id"], {})[r["stretch"]] = r["text"]
        assert len(ends) == parts.count() and len(stretches[1]) == 23
        for conv, texts in stretches.items():
            assert sorted(texts) == list(range(len(texts)))
            whole = [ch.read_line(x) for k in sorted(texts) for x in texts[k].split("\n")]
            found = []
            for k in sorted(texts):
                entry, end = ends[conv, k]
                assert (entry is None) == (k == 0) and (k == 0 or entry == found[-1])
                found += model.states([ch.read_line(x) for x in texts[k].split("\n")], entry, end)
            wanted = model.states(whole)
            assert found == wanted or np.isclose(weight(model, found, whole), weight(model, wanted, whole), rtol=1e-12)


def test_cutting_changes_no_role(spark):
    df, model = spark.createDataFrame(odd_conversations(random.Random(5)), SCHEMA), model_from(random.Random(6))

    def roles(stretch):
        out = {}
        rows = ch.format_conversations(df, model, stretch, fan=2).collect()
        for r in sorted(rows, key=lambda r: (str(r["conv_id"]), r["stretch"])):
            mine = r["roles"].split(",")
            known = out.setdefault(r["conv_id"], [])
            assert not r["continues"] or known[-1] == mine[0]
            known += mine[1:] if r["continues"] else mine
        return out, len(rows)

    (whole, n), (cut, m) = roles(1000), roles(5)
    assert n == 7 and m == 39
    assert whole == cut


def test_rows_of_one_turn_are_cut(spark):
    rows = [(None, None, "user", "x")] * 1300 + [(1, 5, "user", "y")] * 600
    found = ch.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["conv_id"]), r["stretch"]) for r in found) == [("1", 0), ("1", 1), ("None", 0), ("None", 1), ("None", 2)]
