"""A Merkle manifest of a table, checked by a recursive climb.

Every row is a leaf. The leaves of a language make a tree, the roots of the
languages make the tree above. A node of two is the hash of both, a node of one
the hash of that one, and hashes are taken over lower-case hex text.

Built levels are stored as node rows. A row covers ten levels: a node at a
station level with the digests of all nodes below it down to the station before
(at most 1,024 of those), and a link to its parent station. ``climb`` is a
recursive query: each leaf starts at its own station; a step appends the
siblings that lie within the station, folds the hash of the leaf with them, and
goes on to the parent station, from the last one of the language to the tree of
languages. One step for ten levels, since every step moves every leaf: forty
levels take four steps.

Stations above the first are shared by many leaves; adaptive execution sends
them to all tasks while they are small and splits the leaves of a station where
they are not. Ranks within a language are taken over stored ranges, so that a
language with most of the rows is no one task.

Rows: nulls in any column are written as ``-``; a null id stands first and is
never tampered with; rows with equal ids stand in the order of their leaves; equal
rows give equal leaves; a null language is a tree of its own, the first; an
empty table gives an empty result. Extra columns are ignored.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.llm.common import only, stored
from copperbook.operators.ordered import row_numbers

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels between two stations, and nodes of the lower one that a station holds.
SPAN = 10
WIDTH = 1 << SPAN
#: The number of the tree above the languages.
TOP = -1
#: One row in so many, by checksum of its id, is tampered with.
TAMPERED = 7


def _part(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and folded, the leaf after tampering; digests of 32 bytes."""
    plain = only(docs, *FIELDS)
    parts = {name: _part(F.col(name)) for name in FIELDS}
    wrong = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    changed = parts | {"n_chars": _part(F.when(wrong, more).otherwise(F.col("n_chars").cast("decimal(38,0)")))}
    leaf = _digest(F.concat(*parts.values()))
    return plain.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        leaf.alias("leaf"),
        # hashed again only where tampering changes it
        F.when(wrong & F.col("n_chars").isNotNull(), _digest(F.concat(*changed.values()))).otherwise(leaf).alias("folded"),
    )


def _station(nodes: Column, last: Column) -> Column:
    """Levels of a station, lowest first. The last one of a tree stops at one node."""

    def parents(level: Column) -> Column:
        def pair(i: Column) -> Column:
            right = F.coalesce(F.lower(F.hex(F.get(level, 2 * i + 1))), F.lit(""))
            return _digest(F.concat(F.lower(F.hex(F.get(level, 2 * i))), right))

        return F.transform(F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int")), pair)

    def up(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(last & (F.size(top) == 1), levels).otherwise(F.concat(levels, F.array(parents(top))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SPAN)), F.array(nodes), up)


def stations(nodes: DataFrame) -> list[DataFrame]:
    """Stored stations by tier, from nodes(tree, pos, n, digest): the nodes of a
    tree are numbered from 0, and n is their count."""
    tiers: list[DataFrame] = []
    while True:
        block = F.shiftright("pos", SPAN)
        blocks = (
            nodes.groupBy("tree", "n", block.alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("held"))  # at most 1,024
            .select(
                "tree",
                F.lit(len(tiers)).alias("tier"),
                "block",
                "n",
                (F.col("n") <= WIDTH).alias("is_last"),
                F.col("held.digest").alias("held"),
            )
        )
        tier = blocks.select(
            "tree",
            "tier",
            "block",
            "n",
            "is_last",
            _station(F.col("held"), F.col("is_last")).alias("levels"),
            # the parent station, and the place of this one among its nodes
            F.when(~F.col("is_last"), F.col("tree")).when(F.col("tree") != TOP, F.lit(TOP).cast("long")).alias("up_tree"),
            F.when(~F.col("is_last"), F.lit(len(tiers) + 1)).otherwise(F.lit(0)).alias("up_tier"),
            F.when(~F.col("is_last"), F.col("block")).otherwise(F.col("tree")).alias("up_pos"),
        )
        tiers.append(stored(tier, "stations"))
        nodes = (
            tiers[-1]
            .where(~F.col("is_last"))
            .select(
                "tree",
                F.col("block").alias("pos"),
                F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"),
                F.element_at(F.element_at("levels", -1), 1).alias("digest"),
            )
        )
        if nodes.isEmpty():
            return tiers


@contextmanager
def _recursion(spark: SparkSession) -> Iterator[None]:
    """No bound on the rows of a recursive query; the setting is put back."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_CLIMB = """
WITH RECURSIVE climb (doc_id, leaf, folded, proof, subroot, root, tree, tier, pos) AS (
    SELECT doc_id, leaf, folded, CAST(array() AS ARRAY<BINARY>), CAST(NULL AS BINARY), CAST(NULL AS BINARY),
           tree, 0, pos
    FROM {leaves}
  UNION ALL
    SELECT doc_id, leaf,
           aggregate(steps, folded, (h, s) -> unhex(sha2(CASE
               WHEN s.sibling IS NULL THEN lower(hex(h))
               WHEN s.is_right THEN lower(concat(hex(s.sibling), hex(h)))
               ELSE lower(concat(hex(h), hex(s.sibling))) END, 256))),
           concat(proof, filter(transform(steps, s -> s.sibling), x -> x IS NOT NULL)),
           CASE WHEN is_last AND tree <> {top} THEN highest ELSE subroot END,
           CASE WHEN is_last AND tree = {top} THEN highest END,
           up_tree, up_tier, up_pos
    FROM (
        SELECT c.doc_id, c.leaf, c.folded, c.proof, c.subroot, n.tree, n.is_last, n.up_tree, n.up_tier, n.up_pos,
               element_at(element_at(n.levels, -1), 1) AS highest,
               transform(
                   slice(sequence(0, {span}), 1, size(n.levels) - 1),
                   l -> named_struct(
                       'sibling', get(element_at(n.levels, l + 1), CAST(shiftright(c.pos & {mask}, l) ^ 1 AS INT)),
                       'is_right', (shiftright(c.pos, l) & 1) = 1)) AS steps
        FROM climb c JOIN {nodes} n
          ON c.tree = n.tree AND c.tier = n.tier AND shiftright(c.pos, {span}) = n.block
    )
)
SELECT doc_id, lower(hex(leaf)) AS leaf, lower(hex(subroot)) AS subroot, lower(hex(root)) AS root,
       sha2(array_join(transform(proof, x -> lower(hex(x))), ''), 256) AS proof_sha256,
       lower(hex(folded)) AS folded_root, folded = root AS verified
FROM climb WHERE tree IS NULL
"""


def climb(started: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per leaf its proof and folded root, from started(doc_id, leaf, folded,
    tree, pos) and the stations of all tiers; stored."""
    spark = started.sparkSession
    with _recursion(spark):
        found = spark.sql(
            _CLIMB, leaves=started, nodes=nodes, top=TOP, span=SPAN, mask=WIDTH - 1
        )
        return stored(found, "climb")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row."""
    each = stored(leaves(docs), "leaves")
    langs = row_numbers(each.groupBy("lang").agg(F.count("*").alias("n")), ["lang"], "tree")
    langs = stored(langs.select(F.col("lang").alias("__lang"), "n", (F.col("tree") - 1).alias("tree")), "langs")
    treed = each.join(langs, F.col("lang").eqNullSafe(F.col("__lang"))).drop("lang", "__lang")
    numbered = row_numbers(treed, ["doc_id", "leaf"], "pos", ("tree",)).withColumn("pos", (F.col("pos") - 1).cast("long"))
    started = stored(numbered.withColumn("tree", F.col("tree").cast("long")), "numbered")
    low = stations(started.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    ends = [t.where("is_last").select("tree", F.element_at(F.element_at("levels", -1), 1).alias("digest")) for t in low]
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.unionByName(more)
    high = stations(
        roots.select(
            F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(langs.count()).cast("long").alias("n"), "digest"
        )
    )
    nodes = low[0]
    for tier in [*low[1:], *high]:
        nodes = nodes.unionByName(tier)
    return climb(started.select("doc_id", "leaf", "folded", "tree", "pos"), nodes)


#: Per language by window functions, then up both trees, level by level.
ORACLE = """
WITH RECURSIVE
fields AS (
    SELECT doc_id, lang, n_chars,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a,
        coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS b,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS c,
        coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1)::VARCHAR, '-') AS c_wrong,
        coalesce(strlen(text) || ':' || text, '-') AS d,
        xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1))
            )
        )) AS crc
    FROM documents
),
hashed AS (
    SELECT doc_id, lang, sha256(a || b || c || d) AS leaf,
        CASE WHEN crc % 7 = 0 THEN sha256(a || b || c_wrong || d) ELSE sha256(a || b || c || d) END AS tampered
    FROM fields
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
    FROM hashed
),
low (tree, level, pos, h, n) AS (
    SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n
),
subroots AS (SELECT tree, h FROM low WHERE n = 1),
high (level, pos, h, n) AS (
    SELECT 0, tree, h, count(*) OVER () FROM subroots
  UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM high WHERE n > 1 GROUP BY level, pos // 2, n
),
nodes AS (
    SELECT tree, level, pos, h, n FROM low
  UNION ALL
    SELECT -1, level, pos, h, n FROM high
),
climb (doc_id, leaf, home, first_pos, tree, level, pos, folded, proof) AS (
    SELECT doc_id, leaf, tree, pos, tree, 0, pos, tampered, '' FROM placed
  UNION ALL
    SELECT c.doc_id, c.leaf, c.home, c.first_pos,
        CASE WHEN own.n = 1 THEN -1 ELSE c.tree END,
        CASE WHEN own.n = 1 THEN 0 ELSE c.level + 1 END,
        CASE WHEN own.n = 1 THEN c.home ELSE c.pos // 2 END,
        CASE WHEN own.n = 1 THEN c.folded
             WHEN sib.h IS NULL THEN sha256(c.folded)
             WHEN c.pos % 2 = 1 THEN sha256(sib.h || c.folded)
             ELSE sha256(c.folded || sib.h) END,
        c.proof || CASE WHEN own.n = 1 THEN '' ELSE coalesce(sib.h, '') END
    FROM climb c
    JOIN nodes own ON own.tree = c.tree AND own.level = c.level AND own.pos = c.pos
    LEFT JOIN nodes sib ON sib.tree = c.tree AND sib.level = c.level AND sib.pos = xor(c.pos, 1)
    WHERE NOT (c.tree = -1 AND own.n = 1)
),
top AS (SELECT h FROM high WHERE n = 1)
SELECT c.doc_id, c.leaf, s.h AS subroot, top.h AS root, sha256(c.proof) AS proof_sha256,
    c.folded AS folded_root, c.folded = top.h AS verified
FROM climb c JOIN subroots s ON s.tree = c.home, top
WHERE c.tree = -1 AND c.level = (SELECT max(level) FROM high)
"""
