"""Secret scans with a battery of randomness tests.

Three patterns give the base spans: assignments, access keys, long hex runs. The
battery adds spans of kind ``random``. A candidate has at least ``LEAST`` letters,
digits and ``+/_-`` with a digit among them. A run of these ends at ``=``, which
stays only as padding, so a name before it does not count. Where a run holds ``/``,
``_`` or ``-``, each part between them is a candidate too, with its own encoding;
of spans inside one another the outer one is reported. A run with ``=`` whose
pieces are all too short is tested whole. The encoding is the smallest alphabet
that holds a candidate, and over that alphabet it must look random:

* chi-squared: the symbols' counts are no further from uniform than chance;
* runs: upper and lower half of the alphabet alternate as chance has it;
* serial correlation: a symbol says nothing of the next.

Any short text can pass, so a discovery must also be told from ordinary names.
Their letters, capitals and digits come in long stretches: at most ``RARE`` of
the places switch. The likelihood of the switches under the encoding over that
under ordinary text is an e-value, and its inverse a p-value, which falls with
the length of the run. Benjamini and Hochberg's rule over all candidates of the
table holds the share of false discoveries at ``FALSE_RATE``: the p-values go
into a histogram of bounded size, and one number comes back.

Everything is DataFrame functions over one row; only the histogram is shuffled.
Places are found by setting a mark around each match and splitting there. Texts
are searched once and take time in proportion to their length and matches.

Rows: null and empty texts have no spans; ties go by start, then kind as listed;
repeated rows are each reported; long texts are read whole; empty tables give
empty results; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.functions.folds import running
from copperbook.functions.text import let
from copperbook.llm.common import only, stored

#: Fixed patterns of the base; the first is filtered by the length of its value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8

LEAST = 20
RARE = 0.15
FALSE_RATE = 0.01
TOO_ODD = 3.5
_RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_RUN}])(?=[A-Za-z+/_=-]*[0-9])[{_RUN}]{{{LEAST},}}"
_PADDING = rf"(?:=+(?![{_RUN}]))?"
PIECE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{LEAST},}}+{_PADDING}"
#: Of a piece with a separator: what follows one, or stands before one.
_PART = rf"(?=[A-Za-z+]*[0-9])[A-Za-z0-9+]{{{LEAST},}}+"
PART = rf"(?<![A-Za-z0-9+])(?:(?<=[/_-]){_PART}{_PADDING}|{_PART}(?=[/_-]))"
KINDS = ("assign", "access", "hex", "random")
_BINS = 4000  # hundredths of a power of ten

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, pattern of the whole run, alphabet; the first that fits is taken.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/-_"),
)


def _switch_rate(alphabet: str) -> float:
    classes = [sum(c in of for c in alphabet) for of in (_DIGITS, _LOWER, _UPPER, "+/-_")]
    return 1 - sum((n / len(alphabet)) ** 2 for n in classes)


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern, left to right: structs of start, end and value, in
    code points. The mark is a control character that no pattern holds; where
    the text has it, another such character stands in. Takes time in proportion to
    the text, however many matches it has."""
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$0\x01")
    kind = "struct<start:int,end:int,value:string>"

    def step(at, piece):
        end = at + F.length(piece)
        return F.struct(end.alias("state"), F.struct(at.alias("start"), end.alias("end"), piece.alias("value")).alias("out"))

    # bound once, since its blocks are taken from it one by one
    walked = let(F.split(marked, "\x01"), lambda pieces: running(pieces, F.lit(0), step, kind))
    inside = F.filter(walked, lambda _, i: i % 2 == 1)
    return F.when(text.rlike(pattern), inside).otherwise(F.array().cast(f"array<{kind}>"))


def _assignments(text: Column) -> Column:
    return F.filter(
        _located(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_VALUE
    )


def _encoding(value: Column) -> Column:
    """Place of the encoding in the list."""
    out = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(value.rlike(ENCODINGS[k][1]), k).otherwise(out)
    return out


def _of(encoding: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), encoding)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _tested(candidates: Column) -> Column:
    """Each candidate with the verdict of the battery and its p-value's bin."""
    coded = F.transform(
        candidates,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            _encoding(c["value"]).alias("code"),
            F.split(F.regexp_replace(c["value"], "=", ""), "").alias("chars"),
        ),
    )
    placed = F.transform(
        coded,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            c["code"].alias("code"),
            _of(c["code"], [float(len(a)) for _, _, a in ENCODINGS]).alias("k"),
            F.transform(
                c["chars"], lambda ch: F.instr(_of(c["code"], [a for _, _, a in ENCODINGS]), ch).cast("double") - 1
            ).alias("x"),
            F.transform(
                c["chars"],
                lambda ch: F.when(ch.rlike("[0-9]"), 0).when(ch.rlike("[a-z]"), 1).when(ch.rlike("[A-Z]"), 2).otherwise(3),
            ).alias("kind"),
        ),
    )
    measured = F.transform(placed, _measures)
    return F.transform(measured, _verdict)


def _changes(values: Column) -> Column:
    changed = F.filter(values, lambda v, i: (i > 0) & (F.get(values, i - 1) != v))
    return F.size(changed).cast("double")


def _measures(c: Column) -> Column:
    x, k = c["x"], c["k"]
    n = F.size(x).cast("double")
    squares = F.aggregate(
        F.sort_array(x),
        F.struct(F.lit(-1.0).alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")),
        lambda s, v: F.struct(
            v.alias("at"),
            F.when(v == s["at"], s["run"] + 1).otherwise(1.0).alias("run"),
            # a count of c adds 1 + 3 + ... + (2c - 1), its square
            (s["total"] + F.when(v == s["at"], 2 * s["run"] + 1).otherwise(1.0)).alias("total"),
        ),
        lambda s: s["total"],
    )
    high = F.transform(x, lambda v: (v >= k / 2).cast("int"))
    mean = _sum(x) / n
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        c["code"].alias("code"),
        k.alias("k"),
        n.alias("n"),
        squares.alias("squares"),
        F.aggregate(high, F.lit(0.0), lambda s, v: s + v).alias("high"),
        _changes(high).alias("turns"),
        _sum(F.transform(x, lambda v: (v - mean) * (v - mean))).alias("spread"),
        _sum(
            F.transform(x, lambda v, i: F.when(i > 0, (v - mean) * (F.get(x, i - 1) - mean)).otherwise(0.0))
        ).alias("lagged"),
        _changes(c["kind"]).alias("switches"),
    )


def _verdict(c: Column) -> Column:
    n, k = c["n"], c["k"]
    chi = k / n * c["squares"] - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    low = n - c["high"]
    expected = 2 * c["high"] * low / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, (c["turns"] + 1 - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
    z_serial = F.when(c["spread"] > 0, (c["lagged"] / c["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    rate = [_switch_rate(a) for _, _, a in ENCODINGS]
    gain = c["switches"] * _of(c["code"], [math.log10(r / RARE) for r in rate]) + (
        n - 1 - c["switches"]
    ) * _of(c["code"], [math.log10((1 - r) / (1 - RARE)) for r in rate])
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        ((z_chi <= TOO_ODD) & (F.abs(z_runs) <= TOO_ODD) & (F.abs(z_serial) <= TOO_ODD)).alias("random"),
        F.greatest(F.lit(0), F.least(F.lit(_BINS), F.floor(gain * 100).cast("int"))).alias("bin"),
    )


def _candidates(text: Column) -> Column:
    short = F.filter(
        _located(text, CANDIDATE),
        lambda c: (F.length(F.regexp_replace(c["value"], "=", "")) >= LEAST) & ~c["value"].rlike(PIECE),
    )
    return _tested(F.concat(_located(text, PIECE), _located(text, PART), short))


def _listed(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    )


def _searched(docs: DataFrame, text: Column) -> DataFrame:
    """Add n_ of each base kind, __base, its sorted structs of start, kind and end,
    __random, the candidates that pass the battery, and __tested, how many were tested."""
    found = docs.withColumns(
        {"__assign": _assignments(text), "__access": _located(text, ACCESS), "__hex": _located(text, HEX), "__tests": _candidates(text)}
    )
    passed = F.transform(
        F.filter("__tests", lambda c: c["random"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["bin"].alias("bin"))
    )
    return found.withColumns(
        {f"__n_{k}": F.size(f"__{k}").cast("long") for k in KINDS[:3]}
        | {
            "__base": F.sort_array(F.concat(*[_listed(F.col(f"__{k}"), n) for n, k in enumerate(KINDS[:3])])),
            "__random": passed,
            "__tested": F.size("__tests"),
        }
    ).drop("__assign", "__access", "__hex", "__tests")


def discovery_bin(searched: DataFrame, false_rate: float = FALSE_RATE) -> int:
    """Least bin of a p-value that is a discovery, over all rows: the largest rank
    whose p-value is below its share of the rate. What fails the battery is no
    discovery; it counts among the tests and takes no rank."""
    total = searched.agg(F.sum("__tested")).first()[0] or 0
    bins = searched.select(F.explode("__random.bin").alias("bin"))
    counts = dict(bins.groupBy("bin").count().collect())  # at most a row a bin
    rank, least = 0, _BINS + 1
    for bin_ in sorted(counts, reverse=True):
        rank += counts[bin_]
        if 10 ** (-bin_ / 100) <= false_rate * rank / total:
            least = bin_
    return least


def _fresh(base: Column, added: Column) -> Column:
    """The added spans that meet no base span and lie in no longer added one: two
    passes over all spans in order. Before a span, the farthest ends so far tell;
    behind it, the next start of a base span."""
    random = len(KINDS) - 1
    # by start, the longer first, base kinds before the added
    listed = F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind")))

    def forward(state, s):
        end, is_added = -s["minus"], s["kind"] == random
        hidden = is_added & ((state["base"] > s["start"]) | (state["added"] >= end))
        after = F.struct(
            F.when(is_added, state["base"]).otherwise(F.greatest(state["base"], end)).alias("base"),
            F.when(is_added, F.greatest(state["added"], end)).otherwise(state["added"]).alias("added"),
        )
        return F.struct(after.alias("state"), hidden.alias("out"))

    def backward(start, s):
        is_added = s["kind"] == random
        return F.struct(F.when(is_added, start).otherwise(s["start"]).alias("state"), (is_added & (start < -s["minus"])).alias("out"))

    begin = F.struct(F.lit(-1).alias("base"), F.lit(-1).alias("added"))

    def told(spans):
        before = running(spans, begin, forward, "boolean")
        behind = let(F.reverse(spans), lambda back: F.reverse(running(back, F.lit((1 << 31) - 1), backward, "boolean")))
        return F.arrays_zip(spans.alias("s"), before.alias("before"), behind.alias("behind"))

    # each value is bound once, since blocks are taken from it one by one
    every = let(F.sort_array(F.array_distinct(listed)), told)
    kept = F.filter(every, lambda z: (z["s"]["kind"] == random) & ~z["before"] & ~z["behind"])
    return F.transform(
        kept, lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["kind"].alias("kind"), (-z["s"]["minus"]).alias("end"))
    )


def _with_spans(searched: DataFrame, least_bin: int) -> DataFrame:
    """Add __all: sorted structs of start, kind and end."""
    added = _listed(F.filter("__random", lambda c: c["bin"] >= least_bin), len(KINDS) - 1)
    every = F.sort_array(F.concat("__base", _fresh(F.col("__base"), F.col("__added"))))
    return searched.withColumn("__added", added).withColumn(
        "__all", F.when(F.size("__added") > 0, every).otherwise(F.col("__base"))
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_rate: float = FALSE_RATE) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, their digest, all spans."""
    plain = only(docs, id_col, text_col).toDF("doc_id", "text")
    # texts are searched once; what is found is read twice
    searched = stored(_searched(plain, F.coalesce("text", F.lit(""))).drop("text"), "secrets")
    found = _with_spans(searched, discovery_bin(searched, false_rate))
    return found.select(
        "doc_id",
        *[F.col(f"__n_{k}").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("__base")), 256).alias("base_sha256"),
        _written(F.col("__all")).alias("spans"),
    )


_BLOCK = 4096


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each union of overlapping spans replaced. The text is cut into
    blocks first, since taking a part of a long text walks it from its start."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def part(cut: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        held = F.slice(cut, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), start - first * _BLOCK + 1, end - start)

    def step(at, span):
        gap = F.when(span["start"] >= at, F.struct(at.alias("start"), span["start"].alias("end")))
        return F.struct(F.greatest(at, span["end"]).alias("state"), gap.alias("out"))

    gaps = F.filter(running(spans, F.lit(0), step, "struct<start:int,end:int>"), lambda g: g.isNotNull())
    last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), F.length(text).alias("end"))
    every = F.concat(gaps, F.array(last))
    return let(blocks, lambda cut: F.array_join(F.transform(every, lambda g: part(cut, g["start"], g["end"])), mask))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", false_rate: float = FALSE_RATE) -> DataFrame:
    """The rows with every span replaced by the mask; overlapping spans by one.
    Null texts stay null."""
    text = F.col(f"`{text_col}`")
    searched = stored(_searched(docs, F.coalesce(text, F.lit(""))), "secrets")
    found = _with_spans(searched, discovery_bin(searched, false_rate))
    masked = F.when(F.size("__all") > 0, _masked(text, F.col("__all"), mask)).otherwise(text)
    return found.select(*[masked.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
