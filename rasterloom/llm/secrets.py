"""Secret scans: fixed patterns, and a character convolutional network over further candidates."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common
from .quality import pool_adjacent

# The base patterns and the least length of a finding.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "learned")

#: What the network judges: long unbroken strings.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
HEXLIKE = re.compile("[0-9A-Fa-f-]+")
LEAST, SEPARATORS = 16, "/._-=+"
#: Characters of a candidate's head, and of the context before and after it, that the network sees.
HEAD, BEFORE, AFTER = 48, 24, 12
#: Characters between the windows of a longer candidate, and windows that are scored at once.
STEP, WINDOWS = 16, 2048
#: Kinds of candidates by their characters; each has a threshold of its own.
SHAPES = ("hex", "plain", "marked")
WIDTH, FILTERS, KERNEL, HIDDEN = HEAD + BEFORE + AFTER, 24, 4, 24
#: Share of candidates that are no secrets which may pass where the recall allows more.
FALSE_SHARE = 0.005
#: Rows of documents whose words go into the labelled findings that are no secrets, the bytes of the longest, and words at most.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_WORDS = 200, 1 << 16, 4000


def _char_features() -> np.ndarray:
    """ASCII -> features: the letter in either case, its case, whether it is a vowel, digit, and kinds of marks; the last row pads."""
    t = np.zeros((129, 38), dtype=np.float32)
    for i in range(128):
        c = chr(i)
        if c.isalpha():
            t[i, ord(c.lower()) - 97] = 1
            t[i, 26], t[i, 27] = c.isupper(), c in "aeiouAEIOU"
        else:
            kind = next((k for k, marks in enumerate(("0123456789", "+/", "=", "_", "-", ".", "\"'", ":,", " \t\r\n")) if c in marks), 9)
            t[i, 28 + kind] = 1
    return t


_FEATURES = _char_features()
PAD = 128


def window(text: str, start: int, end: int) -> np.ndarray:
    """Characters around a candidate; PAD pads, and other than ASCII ones count as marks."""
    before, head, after = text[max(0, start - BEFORE) : start], text[start : min(end, start + HEAD)], text[end : end + AFTER]

    def codes(s, n, right=False):
        c = [ord(x) if ord(x) < 127 else 127 for x in s]
        return [PAD] * (n - len(c)) + c if right else c + [PAD] * (n - len(c))

    return np.array(codes(before, BEFORE, True) + codes(head, HEAD) + codes(after, AFTER), dtype=np.uint8)


def shape_of(candidate: str) -> str:
    """Hexadecimal digits and hyphens, letters and digits alone, or with other marks."""
    return "hex" if HEXLIKE.fullmatch(candidate) else "plain" if candidate.isalnum() else "marked"


def heads(text: str, start: int, end: int) -> list[int]:
    """Starts of the windows over a candidate: overlapping ones over all of it, and one behind each separator."""
    if end - start <= HEAD:
        return [start]
    parts = [i for i in range(start + 1, end - LEAST + 1) if text[i - 1] in SEPARATORS and text[i] not in SEPARATORS]
    return sorted({*range(start, end - HEAD, STEP), end - HEAD, *parts})


class CharConvNet:
    """Convolution over characters -> ReLU -> pooling -> a hidden layer -> logistic output.

    Pooled are the largest and the mean response over the candidate and the largest over its
    context, apart, so that a context cannot hide what the candidate looks like.
    """

    def __init__(self, seed: int = 3):
        rng, n = np.random.default_rng(seed), _FEATURES.shape[1]
        self.k = rng.normal(scale=0.3, size=(KERNEL, n, FILTERS))
        self.kb = np.zeros(FILTERS)
        self.h = rng.normal(scale=(3 * FILTERS) ** -0.5, size=(3 * FILTERS, HIDDEN))
        self.hb = np.zeros(HIDDEN)
        self.w = rng.normal(scale=HIDDEN**-0.5, size=HIDDEN)
        self.b = np.zeros(1)
        self.k, self.kb, self.h, self.hb, self.w, self.b = (p.astype(np.float32) for p in (self.k, self.kb, self.h, self.hb, self.w, self.b))
        self.xs, self.ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.levels = dict.fromkeys(SHAPES, 0.0)

    def _forward(self, x):
        n = WIDTH - KERNEL + 1
        tables = [_FEATURES @ k for k in self.k]  # a response for each character and place in the kernel
        a = self.kb + sum(t[x[:, i : i + n]] for i, t in enumerate(tables))
        a = np.maximum(a, 0)
        inside = np.zeros((len(x), n), dtype=bool)
        inside[:, BEFORE : BEFORE + HEAD - KERNEL + 1] = x[:, BEFORE + KERNEL - 1 : BEFORE + HEAD] != PAD
        size = np.maximum(1, inside.sum(axis=1))[:, None].astype(np.float32)
        own = a * inside[..., None]
        rest = a - own
        pooled = np.hstack([own.max(axis=1), own.sum(axis=1) / size, rest.max(axis=1)])
        hidden = np.maximum(pooled @ self.h + self.hb, 0)
        return a, inside, size, own, rest, pooled, hidden, hidden @ self.w + self.b[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, scores: np.ndarray) -> np.ndarray:
        """Scores on the calibration curve: the share of secrets among findings of such a score."""
        return np.interp(scores, self.xs, self.ys)

    def calibrate(self, scores: np.ndarray, y: np.ndarray) -> None:
        """Isotonic fit."""
        order = np.argsort(scores, kind="stable")
        self.xs, self.ys = scores[order], pool_adjacent(y[order], np.ones(len(y)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.004, batch: int = 64, seed: int = 4) -> None:
        """Stochastic gradient descent with adaptive steps that shrink towards the end."""
        rng, n = np.random.default_rng(seed), WIDTH - KERNEL + 1
        params = [self.k, self.kb, self.h, self.hb, self.w, self.b]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                s = order[i : i + batch]
                a, inside, size, own, rest, pooled, hidden, z = self._forward(x[s])
                d = ((1 / (1 + np.exp(-z)) - y[s]) / len(s)).astype(np.float32)
                dh = np.outer(d, self.w) * (hidden > 0)
                dp = dh @ self.h.T
                da = (dp[:, FILTERS : 2 * FILTERS] / size)[:, None, :] * inside[..., None]
                for part, g in ((own, dp[:, :FILTERS]), (rest, dp[:, 2 * FILTERS :])):
                    top = part.argmax(axis=1)[:, None, :]
                    np.put_along_axis(da, top, np.take_along_axis(da, top, 1) + g[:, None, :], 1)
                da *= a > 0
                flat = da.reshape(-1, FILTERS)
                dk = np.stack([_FEATURES[x[s][:, j : j + n]].reshape(-1, _FEATURES.shape[1]).T @ flat for j in range(KERNEL)])
                grads = [dk, flat.sum(axis=0), pooled.T @ dh, dh.sum(axis=0), hidden.T @ d, np.array([d.sum()])]
                step = rate * (1 - t / total)
                t += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets that the characters of labelled secrets are drawn from.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER, LOWER, UPPER + "234567", LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "-_")
SYLLABLES = "th er an re on st ing ou le de es ti or qu en ka mo ri sch ung heit keit pro con ment ly ver auf tion al ca do na pre sub ter".split()


class Findings:
    """Labelled candidates in their contexts. Length, alphabet, prefix, separators and context are drawn one by one, whatever the label.

    Secrets are random characters; others are made of words, dates, numbers, paths, names in
    programs, versions, identifiers of records and rulers.
    """

    def __init__(self, seed: int, words: list[str] | None = None):
        self.rng, self.words = np.random.default_rng(seed), words or []

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def draw(self, alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), k))

    def number(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def word(self) -> str:
        if self.words and self.rng.random() < 0.5:
            return self.pick(self.words)
        if self.rng.random() < 0.5:
            return "".join(self.pick(SYLLABLES) for _ in range(self.number(1, 4)))
        onset, vowel, coda = "b c d f g h j k l m n p qu r s t v w z st tr pl cr br sh ch th".split(), "aaeeeiioou", ("", "", "n", "r", "s", "l", "t", "m", "d", "x", "ck", "nd", "rt", "ll", "y")
        return "".join((self.pick(onset) if i or self.rng.random() < 0.8 else "") + self.pick(vowel) + (self.pick(vowel) if self.rng.random() < 0.15 else "") + self.pick(coda) for i in range(self.number(1, 3)))

    def secret(self) -> str:
        alphabet, size = self.pick(ALPHABETS), int(16 * 8 ** self.rng.random())
        body = self.draw(alphabet, size)
        form = self.rng.random()
        if form < 0.15:  # parts of random characters
            mark = self.pick("-._")
            body = mark.join(self.draw(self.pick((alphabet, DIGITS)), self.number(6, 24)) for _ in range(self.number(1, 3))) + mark + self.draw(alphabet, self.number(16, 40))
        if self.rng.random() < 0.35:
            body = self.draw(self.pick((LOWER, UPPER, LOWER + UPPER)), self.number(2, 5)) + self.pick(("-", "_", "", ".")) + body
        if alphabet.endswith("+/") and self.rng.random() < 0.5:
            body += "=" * self.number(1, 2)
        return body

    def plain(self) -> str:
        w, d = self.word, lambda k: self.draw(DIGITS, k)
        cased = lambda: self.pick((str.lower, str.capitalize, str.upper))(w())
        joined = lambda marks, low=2, high=5: self.pick(marks).join(cased() for _ in range(self.number(low, high)))
        uuid = "-".join(self.draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
        made = [
            lambda: joined("-_./"), lambda: "/".join(cased() for _ in range(self.number(2, 7))) + self.pick(("", ".html", ".py", "/v" + d(1) + "." + d(1), "?", "/" + d(5))).replace("?", ""),
            lambda: "".join(w().capitalize() for _ in range(self.number(3, 6))), lambda: joined("_", 2, 4) + self.pick(("_", "", "-")) + d(self.number(1, 6)), lambda: "".join(w() for _ in range(self.number(3, 8))),
            lambda: w().upper() + "_" + "_".join(w().upper() for _ in range(self.number(1, 4))), lambda: "_".join(w().upper() for _ in range(self.number(3, 6))),
            lambda: ".".join(w() for _ in range(self.number(2, 4))) + self.pick((".com", ".org", ".net", ".io")) + self.pick(("", "/")) + joined("/", 1, 3) + self.pick(("", d(self.number(1, 4)))), lambda: self.pick((uuid, uuid.upper())), lambda: d(self.number(16, 40)), lambda: "-".join(d(k) for k in (4, 2, 2, 2, 2, 6)),
            lambda: f"20{d(2)}-{d(2)}-{d(2)}_{joined('_-')}.{self.pick(('log', 'txt', 'csv'))}", lambda: self.pick("=-_.+") * self.number(10, 60) + d(self.number(0, 2)), lambda: ".".join(d(3) for _ in range(self.number(4, 6))) + "-" + d(8),
            lambda: joined(".", 2, 4) + f"-{d(1)}.{d(2)}.{d(1)}" + self.pick(("", ".tar.gz", "-py3-none-any.whl")), lambda: w() + "." + w().capitalize() + "..." + cased() + "." + w(), lambda: self.pick((w(), d(1))) * self.number(6, 16),
            lambda: "www." + w() + ".com/" + joined("/", 2, 4) + "/" + d(self.number(4, 12)), lambda: joined("-", 3, 8) + "-" + d(self.number(1, 8)), lambda: self.pick("=-") * self.number(3, 12) + joined("_-") + self.pick("=-") * self.number(3, 12),
        ]
        out = self.pick(made)()
        while len(out) < LEAST:
            out += self.pick("-_/.") + self.pick((w(), d(2)))
        return out

    def case(self, secret: bool) -> tuple[str, int, int]:
        """(text, start, end) of a candidate in a context."""
        body = self.secret() if secret else self.plain()
        if self.rng.random() < 0.1:  # behind or before something else in one run
            other = "/".join(self.word() for _ in range(self.number(2, 5)))
            body = self.pick((f"{other}/{body}", f"{body}/{other}", f"{other}={body}"))
        lead = self.pick(("", f"{self.word()} ", f"{self.word()}: ", f"{self.word()} = \"", f"{self.word().upper()}=", "key: ", "api_key_value = ", "Authorization: Bearer ", "export AUTH='", "see ", "id ", "file ", "(", "https://", "\n", "<", "credential \""))
        before = f"{self.word()} {self.word()} {lead}"
        return before + body + self.pick(("\" ", " ", ". ", "\n", "' ", ") ", ", ", "; ", "")) + self.pick(("", self.word())), len(before), len(before) + len(body)


def labelled_findings(n: int = 12_000, seed: int = 9, words: list[str] | None = None) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Labelled candidates, secrets and others by turns; see ``Findings``."""
    make = Findings(seed, words)
    return [make.case(i % 2 == 0) for i in range(n)], np.array([i % 2 == 0 for i in range(n)], dtype=float)


def sample_words(docs: DataFrame) -> list[str]:
    """Words of a bounded sample of documents, for labelled findings that are no secrets: letters alone, 3 to 15 of them."""
    few = common.hash_sample(docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text"), "doc_id", SAMPLE_ROWS).collect()
    return sorted({w for r in few for w in re.findall("(?<![A-Za-z0-9])[A-Za-z]{3,15}(?![A-Za-z0-9])", r.text)})[:: max(1, len(few) // 20)][:SAMPLE_WORDS]


_MODELS: dict[tuple, CharConvNet] = {}


def trained_network(recall: float = 0.98, words: tuple = ()) -> CharConvNet:
    """Train on labelled findings; of the others, half fit the calibration curve and half the thresholds.

    Calibration and thresholds look at what a scan looks at: the highest score of the windows over a
    candidate. A shape's threshold is the score that the wanted share of its held-out secrets
    reaches, or, where fewer of the others than FALSE_SHARE reach that, the middle between it and the
    level that so many of them reach; the recall is never less.
    """
    if (recall, words) not in _MODELS:
        cases, y = labelled_findings(words=list(words))
        shapes = np.array([shape_of(t[s:e]) for t, s, e in cases])
        part, rng = (np.arange(len(y)) // 2) % 5, np.random.default_rng(5)
        train = np.flatnonzero(part > 1)
        x = np.stack([window(t, s if e - s <= HEAD else int(rng.choice(heads(t, s, e))), e) for t, s, e in (cases[i] for i in train)])
        net = CharConvNet()
        net.fit(x, y[train])
        held = np.flatnonzero(part <= 1)
        scores = np.zeros(len(y))
        scores[held] = span_scores(net, [cases[i] for i in held])
        net.calibrate(scores[part == 0], y[part == 0])
        for shape in SHAPES:
            own, other = (scores[(part == 1) & (y == label) & (shapes == shape)] for label in (1, 0))
            low = float(np.quantile(own, 1 - recall)) if len(own) else 0.0
            net.levels[shape] = (low + min(low, float(np.quantile(other, 1 - FALSE_SHARE)))) / 2 if len(other) else low
        if len(_MODELS) > 3:
            _MODELS.clear()
        _MODELS[recall, words] = net
    return _MODELS[recall, words]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the network judges: the parts of long runs that no fixed finding covers.

    Both lists are walked once, so the time grows with the text's length alone.
    """
    found: list[tuple[int, int, int]] = []

    def add(at: int, end: int) -> None:
        if end - at >= LEAST:
            found.append((at, 3, end))

    k, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][0] < end:
            s, _, e = base[k]
            add(max(at, reach), s)
            reach, k = max(reach, e), k + 1
        add(max(at, reach), end)
    return found


def span_scores(net: CharConvNet, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """The highest score of the windows over each (text, start, end)."""
    best, at, held = np.full(len(spans), -np.inf), [], []

    def flush():
        distinct, where = np.unique(np.stack(held), axis=0, return_inverse=True)  # a ruler has the same window many times
        np.maximum.at(best, at, net.score(distinct)[where.ravel()])
        at.clear()
        held.clear()

    for i, (text, start, end) in enumerate(spans):
        for h in heads(text, start, end):
            at.append(i)
            held.append(window(text, h, end))
            if len(held) == WINDOWS:
                flush()
    if held:
        flush()
    return best


def scan_secrets(docs: DataFrame, recall: float = 0.98) -> DataFrame:
    """Findings in every whole text: doc_id and an array of (kind, start, end, score).

    Offsets count code points, end exclusive. Fixed patterns always stay and carry the network's
    calibrated probability of what they matched; the network adds the parts of long runs that no
    fixed finding covers and whose score, the highest of their windows, reaches the threshold of
    their shape. It is trained on labelled findings that are drawn at random; words in those that
    are no secrets come from a bounded sample of the documents. Null texts are empty and have no finding; very long texts and runs
    are scanned whole; ties in start are ordered by kind; repeated rows stay repeated; an empty
    table gives no rows.
    """
    net = trained_network(recall, tuple(sample_words(docs)))

    def f(rows):
        spans, cases = [], []
        for text in rows["text"]:
            text = text or ""
            base = base_spans(text)
            spans.append(base + candidates(text, base))
            cases += [(text, s, e) for s, _, e in spans[-1]]
        scores = span_scores(net, cases)
        scores = iter(zip(scores, net.probability(scores)))
        out = []
        for text, found in zip(rows["text"], spans):
            text = text or ""
            scored = [(s, k, e, *next(scores)) for s, k, e in found]
            out.append([{"kind": KINDS[k], "start": s, "end": e, "score": round(float(p), 6)} for s, k, e, z, p in sorted(scored) if k < 3 or z >= net.levels[shape_of(text[s:e])]])
        return {"doc_id": rows["doc_id"], "findings": out}

    return common.map_rows(docs, ["doc_id", "text"], "doc_id long, findings array<struct<kind: string, start: long, end: long, score: double>>", lambda: f)


def span_list(findings: list[dict]) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in findings)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
