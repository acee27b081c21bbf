"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from . import common

#: Labelled documents used to train and calibrate, at most; predictions cover every whole text.
TRAIN_DOCS = 3_000
#: Of longer training texts the model also learns pieces of these lengths, as it has to know short texts too.
PIECES, LONG = (40, 150, 2000), 400
BUCKETS = 1 << 15
#: Entries that are learnt of a text's bag, at most.
MOST = 4096
DIM = 16
GRAMS = (1, 2, 3, 4)
#: Characters hashed at a time, so that memory does not grow with a text's length.
BLOCK = 1 << 18

LETTER = regex.compile(r"\p{L}")
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> lower-case code point for letters, 32 for everything else."""
    if not _FOLD:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(t)
    return _FOLD[0]


def subwords(text: str):
    """Hash buckets of the character n-grams inside space-padded words, block by block."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, max(1, len(codes)), BLOCK):
        c = _fold_table()[codes[max(0, at - max(GRAMS) + 1) : at + BLOCK]].astype(np.uint64)
        c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
        gap = c == 32
        out = []
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, dtype=np.uint64)
            inner = np.zeros(len(h), dtype=bool)
            for k in range(n):
                h = (h ^ c[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if n == 1 or 0 < k < n - 1:
                    inner |= gap[k : k + len(h)]
            if n == 2:
                inner |= gap[:-1] & gap[1:]
            out.append((h[~inner] & np.uint64(BUCKETS - 1)).astype(np.int32))
        yield np.concatenate(out)


class LangModel:
    """Per-bucket class scores (embedding times softmax weights), bias, temperature and rejection level."""

    def __init__(self, classes: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject: float = 0.0):
        self.classes, self.scores, self.bias, self.temperature, self.reject = classes, scores, bias, temperature, reject

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for h in subwords(text):
            total += self.scores[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected); ``und`` and 0 for a text that is null or has no letters."""
        if text is None or not self.classes or not LETTER.search(text):
            return "und", 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(np.argmax(p))
        return self.classes[k], float(round(p[k], 6)), bool(p[k] < self.reject)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text's subwords and their shares."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for h in subwords(text):
        total += np.bincount(h, minlength=BUCKETS)
    at = np.nonzero(total)[0].astype(np.int32)
    return at, (total[at] / max(1, total.sum())).astype(np.float32)


def learnt_bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's bag, or of a larger one its MOST largest shares, scaled to the same sum."""
    h, c = bag(text)
    if len(h) <= MOST:
        return h, c
    top = np.sort(np.argpartition(-c, MOST)[:MOST])
    return h[top], c[top] * np.float32(c.sum() / c[top].sum())


def cases_of(text: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What is learnt of a text: the whole of it, and of a long one a piece of each length of PIECES as well."""
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    cuts = [int(rng.integers(0, max(1, len(text) - n))) for n in PIECES] if len(text) >= LONG else []
    return [learnt_bag(text)] + [b for n, k in zip(PIECES, cuts) if len((b := bag(text[k : k + n]))[0])]


def fit_language(rows: list[tuple[str, bool, list]], epochs: int = 4, rate: float = 0.6, precision: float = 0.99, seed: int = 5) -> LangModel:
    """Stochastic gradient descent over (language, held, bags of subwords) rows; the held ones calibrate.

    The temperature minimises the log loss of the held rows' whole texts; the rejection level is
    the lowest probability at which their accepted predictions reach ``precision``.
    """
    classes = sorted({lang for lang, _, _ in rows})
    rng = np.random.default_rng(seed)
    emb = rng.normal(scale=0.1, size=(BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    cases = [(h, c, classes.index(lang)) for lang, held, bags in rows if not held for h, c in bags]
    steps, total = 0, max(1, epochs * len(cases))
    for _ in range(epochs):
        for k in rng.permutation(len(cases)):
            h, c, y = cases[k]
            lr = np.float32(rate * (1 - steps / total))
            v = c @ emb[h]
            z = v @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= lr * np.outer(v, p)
            b -= lr * 0.1 * p
            emb[h] -= (lr * 20 * c)[:, None] * back
            steps += 1
    model = LangModel(classes, emb @ w, b.astype(np.float64))
    held = [(c.astype(np.float64) @ model.scores[h] + model.bias, classes.index(lang)) for lang, apart, ((h, c), *_) in rows if apart]
    if held:
        z, y = np.array([a for a, _ in held]), np.array([c for _, c in held])

        def probs(t):
            q = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return q / q.sum(axis=1, keepdims=True)

        model.temperature = float(min(np.geomspace(0.1, 5, 40), key=lambda t: -np.log(probs(t)[np.arange(len(y)), y] + 1e-12).sum()))
        top, right = probs(model.temperature).max(axis=1), probs(model.temperature).argmax(axis=1) == y
        order = np.argsort(-top)
        good = np.nonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision)[0]
        model.reject = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def training_rows(train: DataFrame, id_col: str, text_col: str) -> list[tuple[str, bool, list]]:
    """(language, held, bags) of at most TRAIN_DOCS labelled texts with letters, made where the texts are.

    A text's bag has MOST entries at most and its pieces are short, so what the driver gets is
    bounded, to about 100 MB, whatever the texts' lengths. A fifth of the rows, by a hash, is held for calibration.
    """
    key = F.xxhash64(id_col, text_col, "lang").alias("key")
    known = train.where(F.col(text_col).isNotNull() & F.col("lang").isNotNull()).select(key, text_col, "lang")
    chosen = common.hash_sample(known.select("key"), "key", TRAIN_DOCS)
    rows = known.join(F.broadcast(chosen.distinct()), "key").dropDuplicates(["key"])

    def f(batch):
        out = {"key": batch["key"], "lang": batch["lang"], "bags": []}
        for key, text in zip(batch["key"], batch[text_col]):
            found = cases_of(text, key) if LETTER.search(text) else []
            out["bags"].append([{"at": h.tobytes(), "share": c.tobytes()} for h, c in found])
        return out

    made = common.map_rows(rows, ["key", text_col, "lang"], "key long, lang string, bags array<struct<at: binary, share: binary>>", lambda: f).collect()
    made = sorted((r for r in made if r.bags), key=lambda r: r.key)
    return [(r.lang, r.key % 5 == 0, [(np.frombuffer(b["at"], dtype=np.int32), np.frombuffer(b["share"], dtype=np.float32)) for b in r.bags]) for r in made]


def identify_languages(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text: doc_id, lang_pred, score, rejected.

    ``train`` has (id, text, lang); at most TRAIN_DOCS of its distinct rows with text and lang,
    those of the smallest hash, are learnt from. Null texts and texts without letters get ``und``
    and score 0; so does every text if nothing is labelled. ``rejected`` marks predictions below
    the calibrated level. Equal texts get equal answers, repeated rows stay repeated, very long
    texts are hashed block by block, and an empty table gives no rows.
    """
    model = fit_language(training_rows(train, id_col, text_col))

    def f(batch):
        out = [model.predict(t) for t in batch[text_col]]
        return {"doc_id": batch[id_col], "lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "rejected": [o[2] for o in out]}

    return common.map_rows(docs, [id_col, text_col], "doc_id long, lang_pred string, score double, rejected boolean", lambda: f)
