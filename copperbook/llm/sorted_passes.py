"""Near-duplicate embeddings by sorted projection passes.

Links. A pass draws random hyperplanes and gives each vector the bits of their
signs, concatenated; vectors are sorted by these bits, and every vector is
compared with its neighbours in windows of ``WINDOW`` to twice as many rows
before it. Two vectors at the least cosine share a bit with a probability that
is known, so the number of passes follows from the number of vectors: enough that
a pair at the bound misses all windows once in a thousand (``MISSED``), closer
pairs far more rarely. Only small codes travel through the passes, eight bits an
entry, with a bound on their rounding; pairs that the bound does not decide are
checked on the vectors themselves, in double precision. Linked pairs of all passes
are united into components; of what is surely linked in a lot of rows, only a
star leaves the task.

Counts. A window is bounded and a vector may have any number of partners, so the
links of a vector are counted afterwards, within its component, and are exact
there. A component of up to ``MOST`` different vectors is counted in one task. In
a larger one, two vectors whose angles to its centre add up to no more than the
angle of the bound are linked for certain; running totals over the angle
count these. Only what lies outside, in the shell that this does not decide, is
compared pair by pair, in tiles over many tasks: none or little in a group of
copies, however large, but the square of the shell in a wide, loose component.

Rows: equal vectors are one class, linked with each other, and take one place in
the passes. Vectors that are null, empty, zero or have null or non-finite entries
link with nothing; neither do vectors of unlike lengths. Null ids never name a
component that has another id; repeated ids and rows count as vectors of their
own. An empty table gives an empty result. Extra columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import only, stored
from copperbook.llm.components import components
from copperbook.llm.simhash import _joined
from copperbook.operators.ordered import row_numbers, running_total

COSINE = 0.95
WINDOW = 128
#: Share of the pairs at the least cosine that may miss every window.
MISSED = 0.001
#: Different vectors of a component that one task counts.
MOST = 256
#: Rows of a side of a tile.
TILE = 512
#: Rows whose links are united before a star of each part leaves the task.
LOT = 1 << 14
#: Windows in a range of sorted rows at least: a window that spans the border of
#: two ranges is not seen, so one pair in so many may miss a pass for it.
RANGE = 64
#: Two angles to a centre decide with this to spare.
SLACK = 1e-9


def passes_for(vectors: int, cosine: float = COSINE, window: int = WINDOW) -> int:
    """Enough that a pair at ``cosine`` misses all windows with ``MISSED``: its
    first bits must agree until about ``window`` vectors share them."""
    bits = max(1.0, math.log2(max(2, vectors) / window))
    meet = (1 - math.acos(cosine) / math.pi) ** bits * (1 - 1 / RANGE)
    return max(4, math.ceil(math.log(MISSED) / math.log(1 - meet)))


def _units(values: list[bytes]) -> np.ndarray:
    """Vectors of one length, as rows of length one."""
    rows = np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, bodies, sizes = [], [], []
        for vector in batch.column(1).to_pylist():
            row = np.array([], np.float64) if vector is None or None in vector else np.array(vector, np.float64) + 0.0
            good = len(row) and np.isfinite(row).all() and row.any()
            body = row.tobytes() if good else None
            keys.append(xxhash.xxh3_128_digest(body) if good else None)
            bodies.append(body)
            sizes.append(len(row))
        yield pa.record_batch(
            {
                "vec_id": batch.column(0),
                "key": pa.array(keys, pa.binary()),
                "v": pa.array(bodies, pa.binary()),
                "size": pa.array(sizes, pa.int32()),
            }
        )


def _codes(passes: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                lot = batch.take(pa.array(at))
                rows = _units(lot.column(1).to_pylist())
                step = np.abs(rows).max(axis=1) / 127
                code = np.rint(rows / step[:, None]).astype(np.int8)
                off = np.linalg.norm(rows - code * step[:, None], axis=1)
                blob = pa.array([r.tobytes() for r in code], pa.binary())
                for turn in range(passes):
                    planes = np.random.default_rng([turn, size]).standard_normal((size, 64))
                    bits = np.packbits(rows @ planes > 0, axis=1)
                    # as signed numbers in the order of the bits
                    place = (bits.view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)
                    yield pa.record_batch(
                        {
                            "turn": pa.array(np.full(len(at), turn, np.int32)),
                            "size": pa.array(np.full(len(at), size, np.int32)),
                            "place": pa.array(place),
                            "node": lot.column(0),
                            "code": blob,
                            "step": pa.array(step),
                            "off": pa.array(off),
                        }
                    )

    return run


class _Lot:
    """Consecutive rows of a pass; the last window of the lot before comes first."""

    def __init__(self, cosine: float, window: int):
        self.cosine, self.window = cosine, window
        self.clear()

    def clear(self) -> None:
        self.nodes, self.codes = np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        self.step, self.off = np.zeros(0), np.zeros(0)
        self.old = 0

    def add(self, nodes, codes, step, off) -> None:
        self.codes = np.vstack((self.codes, codes)) if len(self.nodes) else codes
        self.nodes = np.concatenate((self.nodes, nodes))
        self.step, self.off = np.concatenate((self.step, step)), np.concatenate((self.off, off))

    def settle(self) -> pa.RecordBatch:
        """Links of the rows: a star for what is certain, and open pairs."""
        n, parent = len(self.nodes), np.arange(len(self.nodes))
        long_ = 1 + self.off
        open_a, open_b = [], []
        for start in range(self.old, n, self.window):
            end, low = min(n, start + self.window), max(0, start - self.window)
            dots = (self.codes[start:end] @ self.codes[low:end].T) * self.step[start:end, None] * self.step[None, low:end]
            room = self.off[start:end, None] * long_[None, low:end] + long_[start:end, None] * self.off[None, low:end]
            room += 1e-12
            earlier = np.arange(low, end)[None, :] < np.arange(start, end)[:, None]
            a, b = np.nonzero((dots - room >= self.cosine) & earlier)
            _joined(parent, a + start, b + low)
            a, b = np.nonzero((dots - room < self.cosine) & (dots + room >= self.cosine) & earlier)
            open_a.append(a + start)
            open_b.append(b + low)
        child = np.flatnonzero(parent != np.arange(n))
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (open_a, open_b))
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        out = pa.record_batch(
            {
                "a": pa.array(self.nodes[np.concatenate((child, a))]),
                "b": pa.array(self.nodes[np.concatenate((parent[child], b))]),
                "is_open": pa.array(np.repeat([False, True], [len(child), len(a)])),
            }
        )
        self.old = min(n, self.window)
        keep = slice(n - self.old, n)
        self.nodes, self.codes, self.step, self.off = self.nodes[keep], self.codes[keep], self.step[keep], self.off[keep]
        return out


def _windows(cosine: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, current = _Lot(cosine, window), None
        for batch in batches:
            turns, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(turns) != 0) | (np.diff(sizes) != 0)) + 1
            for start, end in zip([0, *edge.tolist()], [*edge.tolist(), len(turns)]):
                if start == end:
                    continue
                if current not in (None, (turns[start], sizes[start])):
                    yield lot.settle()
                    lot.clear()
                current = (turns[start], sizes[start])
                part = batch.slice(start, end - start)
                # sums of products of bytes are exact in this type up to 2**24, else in double
                kind = np.float32 if sizes[start] <= 1024 else np.float64
                codes = np.frombuffer(b"".join(part.column(4).to_pylist()), np.int8).reshape(end - start, -1)
                lot.add(part.column(3).to_numpy(), codes.astype(kind), part.column(5).to_numpy(), part.column(6).to_numpy())
                if len(lot.nodes) - lot.old >= LOT:
                    yield lot.settle()
        if current is not None:
            yield lot.settle()

    return run


def _checked(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, va, vb = (c.to_pylist() for c in batch.columns)
            good = [i for i in range(len(a)) if float(_units([va[i]])[0] @ _units([vb[i]])[0]) >= cosine]
            yield pa.record_batch({"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())})

    return run


def node_links(nodes: DataFrame, cosine: float, window: int, passes: int | None = None) -> DataFrame:
    """links(a, b) of nodes(node, v, size) that the passes find; all are at the cosine."""
    held = nodes.count()
    passes = passes or passes_for(held, cosine, window)
    codes = nodes.select("node", "v", "size").mapInArrow(
        _codes(passes, cosine), "turn int, size int, place long, node long, code binary, step double, off double"
    )
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(most, held * passes // (RANGE * window)))
    order = ["turn", "size", "place", "node"]
    found = codes.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = stored(found.mapInArrow(_windows(cosine, window), "a long, b long, is_open boolean").distinct(), "pass-links")
    vectors = nodes.select("node", "v")
    left = found.where("is_open").select("a", "b").join(vectors.toDF("a", "va"), "a")
    both = left.join(vectors.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    return found.where("NOT is_open").select("a", "b").unionByName(both.mapInArrow(_checked(cosine), "a long, b long"))


def _counted(rows: np.ndarray, copies: np.ndarray, cosine: float) -> np.ndarray:
    linked = rows @ rows.T >= cosine
    np.fill_diagonal(linked, False)
    return linked @ copies


def _whole_groups(cosine: float):
    """Rows in order of root: for each row the weight of its linked partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])

        def settle() -> pa.RecordBatch:
            counts = _counted(_units(held[3]), np.array(held[2], np.int64), cosine)
            return pa.record_batch({"node": pa.array(held[1], pa.int64()), "partners": pa.array(counts, pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] and row[0] != held[0][0]:
                    yield settle()
                    held = ([], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield settle()

    return run


def _unit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        return pa.record_batch({"root": pa.array(list(sums), pa.int64()), "part": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    for batch in batches:
        roots = batch.column(0).to_numpy()
        for root in np.unique(roots).tolist():
            rows = _units(batch.column(1).take(pa.array(np.flatnonzero(roots == root))).to_pylist())
            sums[root] = sums.get(root, 0) + rows.sum(axis=0)
        if len(sums) > 1024:
            yield flush()
            sums = {}
    if sums:
        yield flush()


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots, nodes, copies, v, centre = batch.columns
        angle = []
        for body, mean in zip(v.to_pylist(), centre.to_pylist()):
            middle = np.array(mean)
            length = np.linalg.norm(middle)
            # a zero centre tells nothing: a right angle decides nothing
            chord = np.linalg.norm(_units([body])[0] - middle / length) if length > 1e-6 else np.sqrt(2)
            angle.append(2 * math.asin(min(1.0, float(chord) / 2)))
        yield pa.record_batch({"root": roots, "node": nodes, "copies": copies, "angle": pa.array(angle, pa.float64())})


def _tiles(cosine: float, theta: float):
    """Rows in order of root and tile: weights of partners that angles do not decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            _, low, high, block, nodes, copies, angle, v = zip(*held)
            rows, weight, angle = _units(list(v)), np.array(copies, np.int64), np.array(angle)
            linked = (rows @ rows.T >= cosine) & (angle[None, :] > theta - angle[:, None])
            np.fill_diagonal(linked, False)
            if low[0] != high[0]:
                linked &= np.array(block)[:, None] != np.array(block)[None, :]
            return pa.record_batch({"node": pa.array(nodes, pa.int64()), "partners": pa.array(linked @ weight, pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    yield settle()
                    held = []
                held.append(row)
        if held:
            yield settle()

    return run


def _large_groups(members: DataFrame, cosine: float) -> DataFrame:
    """node, partners for members(root, node, copies, v) of large components."""
    theta = math.acos(cosine) - SLACK
    parts = members.select("root", "v").mapInArrow(_unit_sums, "root long, part array<double>")
    cells = parts.select("root", F.posexplode("part").alias("i", "c")).groupBy("root", "i").agg(F.sum("c").alias("c"))
    centres = cells.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).getField("c").alias("centre"))
    placed = stored(
        members.join(centres, "root")
        .select("root", "node", "copies", "v", "centre")
        .mapInArrow(_angles, "root long, node long, copies long, angle double"),
        "angles",
    )
    given = placed.select("root", F.col("angle").alias("at"), F.lit(0).alias("asks"), "node", "copies")
    asked = placed.select("root", (theta - F.col("angle")).alias("at"), F.lit(1).alias("asks"), "node", F.lit(0).cast("long"))
    total = running_total(given.union(asked), ["at", "asks", "node"], "sure", F.col("copies"), ("root",))
    certain = total.where("asks = 1").select("node", F.col("sure").alias("partners"))
    itself = placed.where(F.col("angle") <= theta - F.col("angle")).select("node", (-F.col("copies")).alias("partners"))

    widest = placed.groupBy("root").agg(F.max("angle").alias("widest"))
    shell = placed.join(widest, "root").where(F.col("angle") > theta - F.col("widest") - SLACK).drop("widest")
    blocked = row_numbers(shell, ["angle", "node"], "number", ("root",))
    blocked = stored(blocked.select("root", "node", "copies", "angle", F.expr(f"(number - 1) div {TILE}").alias("block")), "shell")
    last = blocked.groupBy("root").agg(F.max("block").alias("last"))
    dealt = blocked.join(last, "root").join(members.select("node", "v"), "node")
    other = F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")
    tiles = (
        dealt.select("*", other)
        .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "angle", "v")
        .repartition("root", "low", "high")
        .sortWithinPartitions("root", "low", "high")
        .mapInArrow(_tiles(cosine, theta), "node long, partners long")
    )
    return certain.unionByName(itself).unionByName(tiles).groupBy("node").agg(F.sum("partners").alias("partners"))


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    window: int = WINDOW,
    passes: int | None = None,
    most: int = MOST,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    plain = only(df, id_col, vector_col).toDF("vec_id", "v")
    plain = plain.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    each = stored(plain.mapInArrow(_keyed, "vec_id long, key binary, v binary, size int"), "vectors")
    # equal keys have equal vectors: 128 bits, and the least stands for all
    distinct = each.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.min("v").alias("v"), F.min("size").alias("size")
    )
    nodes = stored(row_numbers(distinct, ["key"], "node"), "nodes").withColumn("node", F.col("node").cast("long"))
    links = node_links(nodes, cosine, window, passes)
    found = components(links)
    roots = found.toDF("node", "root").unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    members = nodes.join(roots, "node").select("root", "node", "copies", "v")
    groups = members.groupBy("root").agg(F.count("*").alias("held"))
    members = stored(members.join(groups, "root"), "members")
    names = ["root", "node", "copies", "v"]
    small = (
        members.where(F.col("held") <= most)
        .select(*names)
        .repartition("root")
        .sortWithinPartitions("root")
        .mapInArrow(_whole_groups(cosine), "node long, partners long")
    )
    counted = small
    large = members.where(F.col("held") > most).select(*names)
    if not large.isEmpty():
        counted = small.unionByName(_large_groups(large, cosine))
    named = nodes.select("node", "key", "low", "copies").join(roots, "node", "left")
    named = named.join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    classes = named.join(lowest, "root").select(
        "key", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("links"), "component"
    )
    linked = each.select("vec_id", "key").join(classes, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return linked.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )
