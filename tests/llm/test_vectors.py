"""Embedding near-dedup against brute force, ties, copies and awkward inputs."""

import numpy as np

from rasterloom.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, n long, node string, low int"


def brute(rows, threshold=0.93):
    ok, units = [], []
    for i, (_, v, label, *_) in enumerate(rows):
        good = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if good:
            ok.append(i)
            units.append(np.array(v, dtype=np.float32).astype(float))
            units[-1] /= np.abs(units[-1]).max()
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            x, y = units[a], units[b]
            if rows[ok[a]][2] == rows[ok[b]][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[ok[a]] += 1
                links[ok[b]] += 1
                parent[find(ok[a])] = find(ok[b])
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], low.get(find(i)), r[0] is not None and r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=str)


def table(rng, n=400, d=12, labels=3):
    base = rng.normal(size=(40, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] * rng.uniform(0.5, 3) + rng.normal(size=d) * rng.choice([0.02, 0.25, 1.0])
        rows.append((i * 3 + 1, [float(np.float32(x)) for x in v], int(rng.integers(labels)), 5, "x", 1))
    return rows


def found(df, **kw):
    return sorted(map(tuple, V.near_vectors(df, **kw).collect()), key=str)


def test_equals_brute_force_with_copies_and_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = table(rng)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 12, [1.0, None] * 6, [nan] + [1.0] * 11, [inf] + [1.0] * 11, [3e38] * 12, [1e-38] * 12, [1.0] * 5, [2.0] * 5]
    rows += [(5000 + i, v, 1, 5, "x", 1) for i, v in enumerate(odd)] + [(6000 + i, [1.0] * 12, None, 5, "x", 1) for i in range(3)]
    rows += [(2, rows[0][1], rows[0][2], 5, "x", 1)] * 4 + [(None, rows[0][1], rows[0][2], 5, "x", 1), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert found(df) == want
    monkeypatch.setattr(V, "TILE_ROWS", 7)
    monkeypatch.setattr(V, "BLOCK_TILES", 2)
    assert found(df) == want
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_are_found_and_given_up_exactly():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 40)) @ np.diag(np.linspace(3, 0.1, 40))
    x[150:] = x[:150] + rng.normal(size=(150, 40)) * 0.4
    u = V.unit(x)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    whole = V.Tile(range(300), [1] * 300, x.tobytes(), 40, axes)
    for threshold in (0.3, 0.8, 0.93, 0.999):
        i, j = V.linked_pairs(whole, whole, threshold)
        want = np.argwhere(np.triu(u @ u.T >= threshold, 1))
        assert {*zip(i.tolist(), j.tolist())} == {*map(tuple, want.tolist())}
    root = V.least_members(6, np.array([5, 3, 1]), np.array([3, 1, 4]))
    assert root.tolist() == [0, 1, 2, 1, 1, 1]


def test_one_long_chain_is_one_component(spark):
    angle = np.arange(60) * 0.3  # neighbours have a cosine of 0.955, others less than 0.93
    rows = [(i, [float(np.cos(a)), float(np.sin(a)), 0.0] if a < 3 else [float(np.cos(a)) * 0.2, float(np.sin(a)) * 0.2, 1.0], 1, 5, "x", 1) for i, a in enumerate(angle)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)
