"""Learned parts against direct computations of the same quantities."""

import numpy as np

from rasterloom.llm import langid, quality
from rasterloom.llm.stats import FEATURES


def isotonic(values, weights):
    """Non-decreasing fit by the max-min formula over all runs."""
    n = len(values)
    mean = lambda a, b: np.average(values[a : b + 1], weights=weights[a : b + 1])
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_pooling_is_the_isotonic_fit():
    rng = np.random.default_rng(4)
    for n in (1, 2, 25):
        values, weights = rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n).astype(float)
        assert np.allclose(quality.pool_adjacent(values, weights), isotonic(values, weights))
    assert len(quality.pool_adjacent(np.zeros(0), np.zeros(0))) == 0


def test_ridge_weights_and_calibration(spark):
    rng, d = np.random.default_rng(6), len(FEATURES)
    x = rng.normal(size=(400, d))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    apart = np.arange(400) % 4 == 0
    rows = [(list(map(float, r)), int(v), bool(c)) for r, v, c in zip(x, y, apart)] + [([0.0] * d, None, False)]
    df = spark.createDataFrame(rows, "features array<double>, label int, calibrate boolean").repartition(5)
    model = quality.fit_quality(df)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    phi = quality.fourier(x[~apart], model.mean, model.scale, model.w, model.b)
    k = phi.shape[1]
    penalty = 1e-3 * len(phi) * np.diag([1.0] * (k - 1) + [0.0]) + 1e-9 * np.eye(k)
    assert np.allclose(model.weights, np.linalg.solve(phi.T @ phi + penalty, phi.T @ y[~apart]), atol=1e-6)
    raw = model.raw(x[apart])
    bins = np.floor(np.clip(raw, -1, 2) * (quality.N_BINS / 3))
    keys = np.unique(bins)
    n = np.array([(bins == b).sum() for b in keys], dtype=float)
    assert np.allclose(model.xs, [raw[bins == b].mean() for b in keys])
    assert np.allclose(model.ys, isotonic(np.array([y[apart][bins == b].mean() for b in keys]), n))
    assert (np.diff(model.score(np.vstack([x[apart][np.argsort(raw)]]))) >= -1e-12).all()


def grams(text):
    """Buckets of the 1- to 4-grams of a text's words with a space at either end, one by one."""
    mask, out = (1 << 64) - 1, []
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    for word in words:
        padded = f" {word} "
        for n in langid.GRAMS:
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip() == "" or (n == 1 and gram == " "):
                    continue
                h = n
                for c in gram:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & mask
                    h ^= h >> 29
                out.append(h & langid.BUCKETS - 1)
    return out


def test_softmax_over_counted_grams():
    rng = np.random.default_rng(2)
    model = langid.LangModel(["aa", "bb", "cc"], rng.normal(size=(langid.BUCKETS, 3)), rng.normal(size=3), temperature=0.3, reject=0.5)
    for text in ("One", "Straße, żółw! 12 x", "a b c d", "漢字 and kana", "A" * 50 + " z"):
        found = grams(text)
        assert sorted(found) == sorted(np.concatenate(list(langid.subwords(text))).tolist())
        z = (model.scores[found].mean(axis=0) + model.bias) / 0.3
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, rejected = model.predict(text)
        assert lang == model.classes[int(p.argmax())] and abs(score - p.max()) < 1e-5 and rejected == (p.max() < 0.5)
        at, share = langid.bag(text)
        assert dict(zip(at.tolist(), share.tolist())) == {b: np.float32(found.count(b) / len(found)) for b in set(found)}
    assert model.predict("12 34") == ("und", 0.0, True) == model.predict(None)
