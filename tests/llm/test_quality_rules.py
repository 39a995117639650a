"""Quality rules: SQL over whole tables, and small cases by hand."""

from copperbook.llm import quality_rules as qr

WORDS = [f"w{k}x" for k in range(400)]


def verdicts(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host int, line int")
    return {(r["doc_id"], r["n_words"]): r for r in qr.judge(df, **options).collect()}


def plain_repeats(words):
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    return len({k + j for k, w in enumerate(windows) if w in again for j in range(3)})


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    common = " ".join(WORDS[:60])
    own = {k: " ".join(f"d{k}_{j}" for j in range(70)) for k in range(6)}
    rows = [(k, f"{common.upper() if k % 2 else common}\n{own[k]}", "a", 0, 0) for k in range(5)]
    rows += [(10 + k, f"  {common}  \nfew words {k}", "a", 0, 0) for k in range(3)]
    rows += [(20, f"{common}\nfew words", "b", 0, 0), (21, own[5], None, 0, 0)]
    found = {d: r for (d, _), r in verdicts(spark, rows, limit=7).items()}
    assert all(found[k]["kept"] and found[k]["n_removed_words"] == 60 for k in range(5))
    assert all(not found[10 + k]["kept"] and not found[10 + k]["base_failed"] for k in range(3))
    assert found[20]["kept"] and found[20]["n_removed_words"] == 0 and found[21]["kept"]
    at_limit = verdicts(spark, rows, limit=8)
    assert all(r["n_removed_words"] == 0 for r in at_limit.values())


def letters(k):
    """Digits are alike in normalised lines."""
    return "".join(chr(97 + int(c)) for c in str(k))


def test_limit_grows_with_the_host(spark):
    own = {k: " ".join(f"{letters(k)}_{letters(j)}" for j in range(60)) for k in range(600)}
    common = " ".join(WORDS[:30])
    rows = [(k, own[k] + f"\n{common}" * (k < 30), "large", 0, 0) for k in range(600)]
    rows += [(1000 + k, f"x{k} " + own[k] + f"\n{common}", "small", 0, 0) for k in range(30)]
    rows += [(2000 + k, f"y{k} " + own[k] + f"\n{common}" * (k < 30), None, 0, 0) for k in range(600)]
    found = {d: r["n_removed_words"] for (d, _), r in verdicts(spark, rows, limit=20, limit_share=10).items()}
    assert all(n == 30 * (1000 <= d < 2000) for d, n in found.items())
    at = {d: r["n_removed_words"] for (d, _), r in verdicts(spark, rows, limit=20, limit_share=5).items()}
    assert at == found  # 30 of 600 is not above 5 percent
    above = {d: r["n_removed_words"] for (d, _), r in verdicts(spark, rows, limit=20, limit_share=4).items()}
    assert sum(n == 30 for n in above.values()) == 90


def test_a_small_loss_does_not_reject(spark):
    head = " ".join(WORDS[:9])
    rows = [(k, f"{head}\n" + " ".join(f"{letters(k)}_{letters(j)}" for j in range(47)), "a", 0, 0) for k in range(30)]
    found = verdicts(spark, rows)
    assert all(r["kept"] and r["n_removed_words"] == 9 for r in found.values())


def test_copies_count_once(spark):
    text = " ".join(WORDS[:80])
    rows = [(k, text, "a", 0, 0) for k in range(30)]
    assert all(r["kept"] for r in verdicts(spark, rows, limit=2).values())


def test_base_counts(spark):
    texts = [
        None, "", " \n\t", "a", "a b c", "a b c a b c", "x " * 200, "1 2\n1 2\n\n\n1 2 ", "ü# é$ <|>&%*",
        " ".join(["a", "b", "c", "d"] * 5), "one two three four one two three",
    ]
    rows = [(k, t, "s", 0, 0) for k, t in enumerate(texts)]
    found = {d: r for (d, _), r in verdicts(spark, rows).items()}
    for k, text in enumerate(texts):
        words = (text or "").split()
        lines = [x for x in (text or "").split("\n") if x.split()]
        assert found[k]["n_words"] == len(words)
        assert found[k]["word_chars"] == sum(map(len, words))
        assert found[k]["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert found[k]["n_dup_lines"] == len(lines) - len(set(lines))
        assert found[k]["n_repeat_words"] == plain_repeats(words)


def test_empty_table(spark):
    assert verdicts(spark, []) == {}


def test_sql_at_a_small_limit(spark, duck, sf_dir):
    sql = qr.ORACLE.replace(f"> {qr.LIMIT})", "> 1)")
    assert sql != qr.ORACLE
    wanted = duck.execute(sql)
    names = [d[0] for d in wanted.description]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r[n] for n in names) for r in qr.judge(docs, limit=1).collect())
    wanted = sorted(wanted.fetchall())
    assert got == wanted
    assert any(r[names.index("n_removed_words")] for r in wanted)
