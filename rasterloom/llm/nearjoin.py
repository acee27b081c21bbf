"""Near-duplicate join: a MinHash LSH forest finds candidates, exact Jaccard similarities decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common
from .decontam import words_of

#: Words of a shingle; a text of fewer words has one shingle.
WIDTH = 5
#: Trees of the forest and hash values in a tree's label (one byte each, so that a label is a sortable 64-bit key).
TREES, DEPTH = 32, 8
#: Shortest prefix that the first pass over the sorted labels looks at; a search that needs a shorter one passes again.
SHORTEST = 6
#: Distinct texts, and their shingles, of a candidate group's block; a task holds two blocks at a time.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Rows of a trie bucket that one task holds at a time.
BUCKET = 2048
#: Edges that one task of the component search handles.
EDGE_ROWS = 20_000
#: Word hashes that a task remembers.
CACHE = 200_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WIDTH)], dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = self.cache.get(word)
        if h is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            h = self.cache[word] = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.array([self._hash(w) for w in words], dtype=np.uint64)
        n = max(1, len(h) - WIDTH + 1)
        s = np.full(n, min(len(h), WIDTH), dtype=np.uint64)
        for k in range(min(WIDTH, len(h))):
            s += h[k : k + n] * _POWERS[k]
            s ^= s >> np.uint64(31)
            s *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(s)


def labels(shingles: np.ndarray) -> list[int]:
    """Label of the text in each tree: the first bytes of its minimum hashes, the first one highest."""
    best = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048]
        np.minimum(best, (x[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=best)
    best ^= best >> np.uint64(33)
    best *= np.uint64(0xFF51AFD7ED558CCD)
    best ^= best >> np.uint64(33)
    mixed = (best >> np.uint64(56)).astype(np.uint8).reshape(TREES, DEPTH)
    return [int(v) for v in np.ascontiguousarray(mixed).view(">i8").ravel()]


def text_keys(text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("k1"), (F.octet_length(text).cast("long") * (1 << 32) + F.crc32(text.cast("binary"))).alias("k2")]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, h1, h2, n, labels): text key, hashes and number of the shingles, labels in the trees."""

    def make():
        shingle = Shingler()

        def f(rows):
            sets = [shingle(t) for t in rows[text_col]]
            digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            return {
                "doc_id": rows[id_col], "k1": rows["k1"], "k2": rows["k2"], "n": [len(s) for s in sets], "labels": [labels(s) if len(s) else [] for s in sets],
                "h1": [int.from_bytes(d[:8], "little", signed=True) for d in digests], "h2": [int.from_bytes(d[8:], "little", signed=True) for d in digests],
            }

        return f

    src = docs.select(id_col, text_col, *text_keys(text_col))
    return common.map_rows(src, [id_col, text_col, "k1", "k2"], "doc_id long, k1 long, k2 long, h1 long, h2 long, n int, labels array<long>", make)


def shared_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that two arrays of labels share."""
    x = (a ^ b).view(np.uint64)
    return sum((x < np.uint64(1 << (64 - 8 * d)) if d < DEPTH else x == 0).astype(np.int32) for d in range(1, DEPTH + 1))


def neighbours(nodes: DataFrame, least: int) -> DataFrame:
    """Pairs next to each other in a tree's sorted labels that share a prefix of ``least`` bytes or more.

    Labels are sorted over the whole cluster by ranges, so a prefix with very many texts lies in
    several partitions. What range bounds part, other trees or the join of buckets bring together.
    """
    rows = nodes.select(F.posexplode("labels").alias("tree", "label"), "node", "n")
    # Signed order is as good as any other: prefixes are contiguous in it.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32())])

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label, node, n = (batch.column(i).to_numpy() for i in range(4))
            if last is not None:
                tree, label, node, n = (np.concatenate([[p], x]) for p, x in zip(last, (tree, label, node, n)))
            last = (tree[-1], label[-1], node[-1], n[-1])
            depth = shared_depth(label[1:].astype(np.int64), label[:-1].astype(np.int64))
            big, small = np.maximum(n[1:], n[:-1]), np.minimum(n[1:], n[:-1])
            ok = (tree[1:] == tree[:-1]) & (depth >= least) & (5 * small.astype(np.int64) >= 4 * big.astype(np.int64))
            a, b = node[1:][ok], node[:-1][ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(depth[ok])], schema=schema)

    pairs = ordered.select("tree", "label", "node", "n").mapInArrow(run, "a long, b long, depth int")
    return pairs.groupBy("a", "b").agg(F.max("depth").alias("depth"))


def with_estimates(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """Pairs whose labels agree in a share of bytes that allows the threshold, with that share."""
    a = nodes.select(F.col("node").alias("a"), F.col("labels").alias("la"))
    b = nodes.select(F.col("node").alias("b"), F.col("labels").alias("lb"))

    def f(batches):
        for batch in batches:
            la = np.frombuffer(batch.column(3).flatten().to_numpy().tobytes(), dtype=np.uint8).reshape(-1, TREES * DEPTH)
            lb = np.frombuffer(batch.column(4).flatten().to_numpy().tobytes(), dtype=np.uint8).reshape(-1, TREES * DEPTH)
            same = (la == lb).mean(axis=1)
            ok = same >= floor
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in range(3)] + [pa.array(same[ok])], names=["a", "b", "depth", "same"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "depth", "la", "lb")
    return joined.mapInArrow(f, "a long, b long, depth int, same double")


def estimated_recall(bins: dict[int, int], depth: int) -> float:
    """Share of all links that prefixes of ``depth`` find, judged by the verified ones.

    ``bins`` counts verified links by hundredths of similarity. A link of similarity s is found
    with probability 1 - (1 - s^depth)^TREES, so each stands for the inverse of that many.
    """
    found = sum(bins.values())
    total = sum(n / (1 - (1 - (s / 100) ** depth) ** TREES) for s, n in bins.items())
    return found / total if total else 1.0


def first_depth(bins: dict[int, int], target: float) -> int:
    """The longest prefix at which links of such estimated similarities, in hundredths, would be found with the target recall.

    Estimates are lowered by one standard deviation, to the threshold at least.
    """
    total = sum(bins.values())
    for depth in range(DEPTH, SHORTEST, -1):
        p = sum(n * (1 - (1 - (max(80.0, s - 2.5) / 100) ** depth) ** TREES) for s, n in bins.items())
        if p >= target * total:
            return depth
    return SHORTEST


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b), comp being the smallest node connected to it.

    Alternates large stars and small stars; each step shuffles the edges once by node, and the
    number of steps grows with the logarithm of the component's size. The edges of a hub are
    dealt to several tasks.
    """
    edges = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    total = edges.count()
    tasks = total // EDGE_ROWS + 1  # few edges are not spread over many small shuffle files
    edges = edges.coalesce(tasks)

    def hubs(least):
        return common.frequent(least, ["u"], "k", total) if total > EDGE_ROWS else least.limit(0).select("u")

    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k").coalesce(tasks)
        large = common.join_spread(both, least.drop("k"), ["u"], hubs(least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        small = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        edges = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = edges.union(large.join(small, "u").select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks)
        edges = common.cut(edges.distinct().coalesce(tasks))
        h = F.xxhash64("u", "v")
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s"), F.count_distinct("u").alias("u")).first()
        if seen == (state.n, state.x, state.s) and state.n == state.u:  # whole numbers, in whatever order they are added
            break
        seen = (state.n, state.x, state.s)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def bucket_edges(members: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) of different groups of a bucket with two texts whose labels allow the threshold.

    ``members`` has (tree, prefix, size, node, n, comp). Rows of a bucket meet in one task, two
    blocks at most at a time; each pair of groups comes out once, as groups that are joined are
    compared text by text later.
    """
    blocks = F.floor((F.col("size") + (BUCKET - 1)) / BUCKET).cast("int")
    rows = members.join(nodes.select("node", "labels"), "node").select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    units = rows.select("tree", "prefix", "block", "node", "n", "comp", "labels", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("tree", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "comp", "labels")
    ordered = units.repartition("tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j")

    def solve(unit, keys, marks):
        block, _, n, comp = keys
        left, right = np.nonzero(block == unit[2])[0], np.nonzero(block == unit[3])[0]
        if len(left) > len(right):
            left, right = right, left
        values, counts = np.unique(comp[right], return_counts=True)
        if len(values) == 0:
            return [], []
        if unit[2] == unit[3]:  # every pair of groups has a text outside the largest
            left = left[comp[left] != values[counts.argmax()]]
        edges: set = set()
        for x in left:
            ok = (comp[right] != comp[x]) & (5 * np.minimum(n[right], n[x]) >= 4 * np.maximum(n[right], n[x]))
            for y in (at := right[ok])[(marks[at] == marks[x]).mean(axis=1) >= floor]:
                edges.add((int(min(comp[x], comp[y])), int(max(comp[x], comp[y]))))
        return [a for a, _ in edges], [b for _, b in edges]

    def run(batches):
        unit, held, marks = None, [], []

        def flush():
            a, b = solve(unit, [np.concatenate(c) for c in zip(*held)], np.concatenate(marks))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            rest = [batch.column(k).to_numpy().astype(np.int64) for k in range(4, 8)]
            lab = np.frombuffer(batch.column(8).flatten().to_numpy().tobytes(), dtype=np.uint8).reshape(-1, TREES * DEPTH)
            starts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for lo, hi in zip(starts, starts[1:]):
                if unit != tuple(keys[lo]):
                    if held:
                        yield flush()
                    unit, held, marks = tuple(keys[lo]), [], []
                held.append([c[lo:hi] for c in rest])
                marks.append(lab[lo:hi])
        if held:
            yield flush()

    return ordered.mapInArrow(run, "a long, b long").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared shingles of every left and every right set, by bit matrices of the shingles they share."""
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    bits = []
    for sets in (left, right):
        m = np.zeros((len(sets), -(-max(1, len(vocabulary)) // 64) * 8), dtype=np.uint8)
        for i, s in enumerate(sets):
            at = np.searchsorted(vocabulary, s)
            at = at[(at < len(vocabulary))][vocabulary[at[at < len(vocabulary)]] == s[at < len(vocabulary)]]
            row = np.zeros(m.shape[1] * 8, dtype=np.uint8)
            row[at] = 1
            m[i] = np.packbits(row)
        bits.append(m.view(np.uint64))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for i in range(len(left)):
        for at in range(0, bits[1].shape[1], 4096):
            out[i] += np.bitwise_count(bits[0][i, at : at + 4096] & bits[1][:, at : at + 4096]).sum(axis=1, dtype=np.int64)
    return out


def exact_links(comps: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verify every pair inside candidate groups: rows (comp, kind, a, b, links, root).

    Every two texts of a group meet in one task, which holds two blocks at most; it emits
    counts per text and, for groups of several blocks, a spanning forest, never the pairs
    themselves. Kind ``node`` has a text's number of linked documents, and the class of groups of
    one block in ``root``; kind ``edge`` a link (a, b) of the forest; kind ``bin`` how many pairs
    have a similarity of a hundredths.
    """
    member = comps.join(nodes.select("node", "n", "copies", F.col("rep.doc_id").alias("doc_id"), F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2")), "node")
    sizes = member.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    member = common.cut(member.join(sizes, "comp").select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")))
    wanted = member.select("node", "comp", "copies", "doc_id", "k1", "k2", "blocks", "block")

    def make():
        shingle = Shingler()

        def f(rows):
            sets = [shingle(t).tobytes() for t in rows[text_col]]
            return {c: rows[c] for c in ("node", "comp", "copies", "blocks", "block")} | {"shingles": sets}

        return f

    keyed = docs.select(F.col(id_col).alias("doc_id"), text_col, *text_keys(text_col)).where(common.bitmap(wanted, "k1", "k2"))
    joined = keyed.join(wanted.withColumnRenamed("doc_id", "rep_id"), ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("rep_id")))
    sets = common.map_rows(joined, ["node", "comp", "copies", "blocks", "block", text_col], "node long, comp long, copies long, blocks int, block int, shingles binary", make)
    # A block meets itself and every other block of its group: unit (i, j), i <= j.
    units = sets.select("comp", "node", "copies", "block", "blocks", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "shingles", "blocks")
    ordered = units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "block", "node")

    def solve(unit, rows, single):
        comp, i, j = unit
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        out: list[tuple] = []  # kind, a, b, links, root
        if not left or not right:
            return out
        a, b = [r[3] for r in left], [r[3] for r in right]
        inter = intersections(a, b)
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        union = na[:, None] + nb[None, :] - inter
        link = 5 * inter >= 4 * union
        if i == j:
            np.fill_diagonal(link, False)
        ca, cb = np.array([r[2] for r in left]), np.array([r[2] for r in right])
        counts = [(r[1], int(c)) for r, c in zip(left, link @ cb)] + ([] if i == j else [(r[1], int(c)) for r, c in zip(right, link.T @ ca)])
        once = np.triu(link) if i == j else link
        hundredths, pairs = np.unique(100 * inter[once] // union[once], return_counts=True)
        out += [("bin", int(h), None, int(k), None) for h, k in zip(hundredths, pairs)]
        edges = []
        parent = {r[1]: r[1] for r in left} | {r[1]: r[1] for r in right}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*np.nonzero(once)):
            u, v = find(left[x][1]), find(right[y][1])
            if u != v:
                parent[max(u, v)] = min(u, v)
                edges.append((left[x][1], right[y][1]))
        out += [("node", n, None, c, find(n) if single else None) for n, c in counts]
        return out if single else out + [("edge", x, y, None, None) for x, y in edges]

    schema = pa.schema([("comp", pa.int64()), ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        unit, rows, single = None, [], True

        def flush():
            found = solve(unit, rows, single)
            columns = [pa.array([unit[0]] * len(found), pa.int64()), *(pa.array([r[k] for r in found], schema.field(k + 1).type) for k in range(5))]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for comp, i, j, block, node, copies, data, blocks in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if unit != (comp, i, j):
                    if unit:
                        yield flush()
                    unit, rows, single = (comp, i, j), [], blocks == 1
                if not rows or rows[-1][1] != node:
                    rows.append((block, node, copies, np.frombuffer(data, dtype=np.uint64)))
        if unit:
            yield flush()

    return ordered.mapInArrow(run, "comp long, kind string, a long, b long, links long, root long")


def candidate_groups(nodes: DataFrame, near: DataFrame, depth: int, least: float) -> DataFrame:
    """(node, comp): texts that share a prefix of ``depth`` bytes in some tree, and whose labels allow the threshold, are in one group.

    ``near`` has neighbours in the sorted labels with the depth they share.
    """
    comps = common.cut(components(near.where(F.col("depth") >= depth).select("a", "b")))

    # Texts that share a prefix but not a group: neighbours in the trie that other texts stand between.
    labelled = nodes.select("node", "n", "labels").join(comps, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), F.posexplode("labels").alias("tree", "label"))
    labelled = common.cut(labelled.select("node", "n", "comp", "tree", F.shiftright("label", 8 * (DEPTH - depth)).alias("prefix")))
    mixed = labelled.groupBy("tree", "prefix").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high").select("tree", "prefix", "size")
    open_ = labelled.join(mixed, ["tree", "prefix"])
    more = common.cut(bucket_edges(open_, nodes, least))
    if more.limit(1).count():
        merged = components(more).withColumnRenamed("node", "group").withColumnRenamed("comp", "into")
        grouped = nodes.select("node").join(comps, "node", "left").withColumn("group", F.coalesce("comp", "node")).join(merged, "group", "left")
        comps = common.cut(grouped.where("comp IS NOT NULL OR into IS NOT NULL").select("node", F.coalesce("into", "group").alias("comp")))
    return comps


def verified_links(nodes: DataFrame, docs: DataFrame, threshold: float, target: float, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The rows of ``exact_links`` at the longest prefix that reaches the target, and its depth.

    One pass over the sorted labels finds neighbours of all depths. The labels' own estimates say
    which prefix should do; what it finds is verified, and while the recall estimated over the
    verified links is below the target, prefixes are shortened by a byte and the groups that
    gained texts are verified anew.
    """
    # Five standard deviations below the threshold: a true link fails this with a probability under one in a million.
    least = threshold - 5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    near = common.cut(with_estimates(neighbours(nodes, SHORTEST), nodes, least))
    likely = near.where(F.col("same") >= threshold).groupBy(F.floor(F.col("same") * 100).cast("int").alias("s")).count().collect()
    solved = sizes = None
    for depth in range(first_depth({r.s: r["count"] for r in likely}, target), 0, -1):
        if depth < SHORTEST:
            near = common.cut(with_estimates(neighbours(nodes, depth), nodes, least))
        groups = candidate_groups(nodes, near, depth, least)
        now = common.cut(groups.groupBy("comp").agg(F.count("*").alias("size")))
        if solved is None:
            solved = common.cut(exact_links(groups, nodes, docs, id_col, text_col))
        else:
            same = now.join(sizes, ["comp", "size"]).select("comp")
            fresh = exact_links(groups.join(same, "comp", "left_anti"), nodes, docs, id_col, text_col)
            solved = common.cut(solved.join(same, "comp", "left_semi").unionByName(fresh))
        sizes = now
        bins = {r.a: r["n"] for r in solved.where("kind = 'bin'").groupBy("a").agg(F.sum("links").alias("n")).collect()}
        if estimated_recall(bins, depth) >= target:
            break
    return solved, depth


def near_duplicates(docs: DataFrame, threshold: float = 0.8, target: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class and number of links of every document: doc_id, class_id, n_links, the text's key k1, k2, and comp.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles
    (lower-cased words, see ``words_of``) is 0.8 or more; a class is a connected component of
    links and its id the smallest doc_id in it. Documents with equal sets are linked, and
    counted, without being compared. Null texts and texts without words are linked to nothing
    and are their own class. Repeated rows count as documents and stay repeated. A null doc_id
    takes part; a class of such rows alone has a null id. Classes that share their smallest doc_id
    share class_id too; ``comp`` tells all classes apart and is null for rows without words. An
    empty table gives no rows.
    """
    if threshold != 0.8:
        raise ValueError("the exact comparison uses the ratio 4/5")
    rows = common.cut(signatures(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    nodes = common.cut(rows.where("n > 0").groupBy("h1", "h2", "n").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "k1", "k2")).alias("rep"), F.min("labels").alias("labels"), F.min("doc_id").alias("first")))
    solved, _ = verified_links(nodes, docs, threshold, target, id_col, text_col)
    counts = solved.where("kind = 'node'").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"), F.max("root").alias("root"))
    spanning = solved.where("kind = 'edge'").select("a", "b")
    classes = components(spanning) if spanning.limit(1).count() else spanning.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    keyed = nodes.select("node", "h1", "h2", "n", "copies", "first").join(classes, "node", "left").join(counts, "node", "left")
    keyed = common.cut(keyed.select("h1", "h2", "n", F.coalesce("root", "comp", "node").alias("comp"), "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first"))
    named = keyed.groupBy("comp").agg(F.min("first").alias("class_id"))
    keyed = common.cut(keyed.join(named, "comp"))
    hot = common.frequent(keyed, ["h1", "h2", "n"], "copies", rows.count())
    worded = common.join_spread(rows.where("n > 0").select("doc_id", "k1", "k2", "row", "h1", "h2", "n"), keyed.select("h1", "h2", "n", "class_id", "n_links", "comp"), ["h1", "h2", "n"], hot)
    worded = worded.select("doc_id", "class_id", "n_links", "k1", "k2", "comp")
    return worded.unionByName(rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "k1", "k2", F.lit(None).cast("long").alias("comp")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps its document of the smallest doc_id.

    Of a class's rows that share that id the one with the smallest text key stays, and one of
    equal rows. Rows of different classes stay, whatever ids they share; rows without words are
    only dropped for an equal row.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    alone = F.when(F.col("comp").isNull(), F.struct("doc_id", "k1", "k2"))
    first = found.groupBy("comp", alone.alias("alone")).agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.k1").alias("__k1"), F.col("f.k2").alias("__k2"))
    k1, k2 = (c.alias(n) for c, n in zip(text_keys(text_col), ("__d1", "__d2")))
    keyed = docs.select("*", k1, k2, F.col(text_col).isNull().alias("__none"))
    kept = keyed.join(first.distinct(), (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__d1") == F.col("__k1")) & (F.col("__d2") == F.col("__k2")), "left_semi")
    return kept.dropDuplicates([id_col, "__d1", "__d2", "__none"]).select(*docs.columns)
