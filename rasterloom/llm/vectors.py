"""Embedding near-dedup: PCA-ordered tiles of vectors, compared by leading dimensions first.

Equal vectors of a label are one row with a weight. Rows are sorted by label and first principal
coordinate and cut into tiles of bounded bytes; runs of tiles are blocks. Two blocks of a label
meet in one task if their ranges of that coordinate are near enough. There, products of two tiles
are summed over the leading coordinates first, and what the others can add is bounded by the norms
of the suffixes: a pair is given up when it cannot reach the threshold, two tiles when no pair can.
A task returns sums for each vector and a spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.functions.workers import reach_workers

from . import common
from .nearjoin import components

#: Bytes and rows of a tile at most (a tile has one row at least), and tiles in a block.
TILE_BYTES, TILE_ROWS, BLOCK_TILES = 256 << 10, 512, 16
#: The rotation is fitted on at most SAMPLE vectors of at most ROTATED dimensions, for the ROTATIONS
#: most common lengths among them; others keep their own axes. It decides speed alone, not results.
SAMPLE, ROTATED, ROTATIONS = 4096, 1024, 8
#: Leading dimensions after which pairs are given up.
STEPS = (4, 8, 16, 24, 32, 48, 64, 128, 256, 512)
#: Rotated products this near to the threshold are decided by the vectors as they are given.
SLACK = 1e-9
#: Share of pairs below which the rest of the products is summed for each pair alone; pairs summed at a time.
FEW, PAIRS = 0.02, 1 << 16


def valid_vector(vec) -> Column:
    """The vector is not null, not all zeros, and has only finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares cannot overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotations(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Length -> principal axes of a bounded sample, the widest first."""
    few = common.hash_sample(distinct.where(F.col("d") <= ROTATED).select("node", "d", "vec"), "node", SAMPLE).collect()
    found = {}
    for d, _ in Counter(r.d for r in few).most_common(ROTATIONS):
        x = unit(np.array([r.vec for r in few if r.d == d]))
        found[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return found


def make_tiles(distinct: DataFrame, axes) -> DataFrame:
    """(label, d, part, seq, lo, hi, nodes, weights, vecs): rows of one label in order of their first principal coordinate."""
    kind = distinct.schema["label"].dataType.simpleString()

    def place():
        rot = axes.value

        def f(rows):
            first = []
            for d, v in zip(rows["d"], rows["vec"]):
                x = unit(np.array([v]))
                first.append(float((x @ rot[d][:, :1])[0, 0] if d in rot else x[0, 0]))
            return {c: rows[c] for c in ("node", "label", "d", "n", "vec")} | {"p": first}

        return f

    placed = common.stored(common.map_rows(distinct, ["node", "label", "d", "n", "vec"], f"node long, label {kind}, d int, n long, vec array<double>, p double", place))
    size = placed.agg(F.sum(F.col("d").cast("long") * 8)).first()[0] or 0
    ordered = placed.repartitionByRange(max(1, min(20_000, size // (BLOCK_TILES * TILE_BYTES) + 1)), "label", "d", "p", "node").sortWithinPartitions("label", "d", "p", "node")

    def pack():
        part, held, seqs = TaskContext.get().partitionId(), [], Counter()

        def flush(out):
            if held:
                label, d = held[0][0], held[0][1]
                row = (label, d, part, seqs[label, d], held[0][4], held[-1][4], [h[2] for h in held], [h[3] for h in held], np.array([h[5] for h in held], dtype=np.float64).tobytes())
                seqs[label, d] += 1
                out.append(row)
                held.clear()

        def frame(out):
            return dict(zip(("label", "d", "part", "seq", "lo", "hi", "nodes", "weights", "vecs"), map(list, zip(*out)))) if out else None

        def add(rows):
            out: list = []
            for row in zip(*(rows[c] for c in ("label", "d", "node", "n", "p", "vec"))):
                if held and (held[0][:2] != row[:2] or len(held) >= max(1, min(TILE_ROWS, TILE_BYTES // (8 * row[1])))):
                    flush(out)
                held.append(row)
            return frame(out)

        def end():
            out: list = []
            flush(out)
            return frame(out)

        return add, end

    schema = f"label {kind}, d int, part int, seq int, lo double, hi double, nodes array<long>, weights array<long>, vecs binary"
    return common.stored(common.map_tasks(ordered, ["label", "d", "node", "n", "p", "vec"], schema, pack))


def paired_tiles(tiles: DataFrame, reach: float) -> DataFrame:
    """Tiles with the pairs of blocks (b1, b2) they take part in; blocks whose first coordinates lie further apart than ``reach`` don't meet."""
    keys = ["label", "d"]
    runs = tiles.groupBy(*keys, "part").agg(F.count("*").alias("c"))
    before = F.expr("coalesce(sum(c) OVER (PARTITION BY label, d ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    runs = runs.select(*keys, "part", before.alias("before"))
    tiles = tiles.join(runs, [*keys, "part"]).withColumn("b", F.floor((F.col("before") + F.col("seq")) / BLOCK_TILES).cast("int"))
    blocks = tiles.groupBy(*keys, "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    left, right = (blocks.select(*keys, *[F.col(c).alias(f"{c}{i}") for c in ("b", "lo", "hi")]) for i in (1, 2))
    cells = left.join(right, keys).where((F.col("b1") <= F.col("b2")) & (F.col("lo2") - F.col("hi1") <= reach)).select(*keys, "b1", "b2")
    sides = F.when(F.col("b1") == F.col("b2"), F.array("b1")).otherwise(F.array("b1", "b2"))
    wanted = common.stored(cells.select(*keys, "b1", "b2", F.explode(sides).alias("b")))
    return tiles.join(wanted, [*keys, "b"]).select(*keys, "b1", "b2", "b", "nodes", "weights", "vecs")


class Tile:
    """Vectors of one tile: as given, rotated, and the norms of what follows each step."""

    def __init__(self, nodes, weights, vecs: bytes, d: int, axes: np.ndarray | None):
        self.nodes, self.weights = np.array(nodes), np.array(weights)
        self.given = unit(np.frombuffer(vecs, dtype=np.float64).reshape(-1, d))
        self.z = self.given if axes is None else self.given @ axes
        squares = np.cumsum((self.z * self.z)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {k: np.sqrt(squares[:, k]) for k in STEPS if k < d}
        self.mid = self.z.mean(axis=0)
        self.radius = float(np.sqrt(((self.z - self.mid) ** 2).sum(axis=1).max()))


def linked_pairs(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of all pairs whose cosine reaches the threshold; of a tile with itself, each pair once."""
    none = np.zeros(0, dtype=np.int64)
    if float(np.sqrt(((a.mid - b.mid) ** 2).sum())) - a.radius - b.radius > np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK:
        return none, none
    d, done = a.z.shape[1], 0
    total = np.zeros((len(a.z), len(b.z)))
    mine = other = None
    for k in [*a.rest, d]:
        if mine is None:
            total += a.z[:, done:k] @ b.z[:, done:k].T
            bound = total if k == d else total + a.rest[k][:, None] * b.rest[k][None, :]
            alive = bound >= threshold - SLACK
            if a is b:
                alive &= np.tri(len(a.z), k=-1, dtype=bool).T
            left = int(alive.sum())
            if left == 0:
                return none, none
            if k == d or left <= FEW * alive.size:
                mine, other = np.nonzero(alive)
                sums = total[mine, other]
        else:
            more = np.empty(len(mine))
            for s in range(0, len(mine), PAIRS):
                more[s : s + PAIRS] = np.einsum("ij,ij->i", a.z[mine[s : s + PAIRS], done:k], b.z[other[s : s + PAIRS], done:k])
            sums = sums + more
            ok = (sums if k == d else sums + a.rest[k][mine] * b.rest[k][other]) >= threshold - SLACK
            mine, other, sums = mine[ok], other[ok], sums[ok]
            if not len(mine):
                return none, none
        done = k
    close = np.flatnonzero(sums < threshold + SLACK)
    keep = np.ones(len(mine), dtype=bool)
    for s in range(0, len(close), PAIRS):
        at = close[s : s + PAIRS]
        keep[at] = np.einsum("ij,ij->i", a.given[mine[at]], b.given[other[at]]) >= threshold
    return mine[keep], other[keep]


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of ``n`` places under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def compare_blocks(d: int, rows: list[tuple], same: bool, threshold: float, axes: np.ndarray | None):
    """(nodes, roots, links) of the vectors with a link between two blocks, or inside one; rows are (b, nodes, weights, vecs)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1][0]))
    tiles = [Tile(n, w, v, d, axes) for _, n, w, v in rows]
    starts = np.concatenate(([0], np.cumsum([len(t.nodes) for t in tiles])))
    links = np.zeros(starts[-1], dtype=np.int64)
    left, right = [], []
    for i, a in enumerate(tiles):
        for j in range(i, len(tiles)):
            if not same and rows[i][0] == rows[j][0]:
                continue
            b = tiles[j]
            x, y = linked_pairs(a, b, threshold)
            if not len(x):
                continue
            np.add.at(links, starts[i] + x, b.weights[y])
            np.add.at(links, starts[j] + y, a.weights[x])
            x, y = (x, y) if i == j else (x, y + len(a.nodes))
            root = least_members(len(a.nodes) + (0 if i == j else len(b.nodes)), x, y)
            at = np.flatnonzero(root != np.arange(len(root)))
            move = lambda p: np.where(p < len(a.nodes), starts[i] + p, starts[j] + p - len(a.nodes))  # noqa: B023, E731
            left.append(move(at))
            right.append(move(root[at]))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes = np.concatenate([t.nodes for t in tiles])
    root = least_members(len(nodes), np.concatenate(left), np.concatenate(right))
    found = np.flatnonzero(links)
    return nodes[found], nodes[root[found]], links[found]


def block_links(pairs: DataFrame, threshold: float, axes) -> DataFrame:
    """(node, root, links) from every pair of blocks."""
    schema = "node long, root long, links long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def compare(table: pa.Table) -> pa.Table:
        d, same = table["d"][0].as_py(), table["b1"][0].as_py() == table["b2"][0].as_py()
        rows = list(zip(*(table[c].to_pylist() for c in ("b", "nodes", "weights", "vecs"))))
        nodes, roots, links = compare_blocks(d, rows, same, threshold, axes.value.get(d))
        return pa.table({"node": nodes, "root": roots, "links": links}, schema=arrow)

    reach_workers(pairs.sparkSession)
    return pairs.groupBy("label", "d", "b1", "b2").applyInArrow(compare, schema)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by a cosine of ``threshold`` or more to others of their label.

    Cosines are in double precision; vectors of different lengths don't link. A vector that is
    null, empty, zero or has null or non-finite components links with nothing, nor does one whose
    label is null: it has no links and is its own component. ``n_links`` counts other rows, equal
    vectors and repeated rows among them. ``component_id`` is the smallest id that links lead to,
    its own included; null ids are passed over and never kept. Rows with one id that is the
    component's are all kept. An empty table gives no rows; other columns are never read.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"), F.col(label_col).alias("label"))
    ok = valid_vector(F.col("vec")) & F.col("label").isNotNull()
    keyed = src.where(ok).select("id", "label", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(13), "vec").alias("h2"), "vec")
    keys = ["label", "h1", "h2"]
    distinct = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.first("vec").alias("vec"))
    distinct = common.stored(distinct.select(*keys, "n", "low", "vec", F.size("vec").alias("d"), F.monotonically_increasing_id().alias("node")))
    axes = spark.sparkContext.broadcast(rotations(distinct))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    found = common.stored(block_links(paired_tiles(make_tiles(distinct, axes), reach), threshold, axes))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.drop("vec").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(comp, "node", "left")
    named = common.stored(named.select(*keys, "n", "low", F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    total = named.agg(F.sum("n")).first()[0] or 0
    out = named.join(lows, "comp").select(*keys, "n_links", "component_id")
    rows = common.join_spread(keyed.select("id", *keys), out, keys, common.frequent(named, keys, "n", total), "left").select("id", "n_links", "component_id")
    alone = src.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return rows.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
