"""Secrets inside long unbroken runs, and of kinds that training has not seen."""

import uuid

import numpy as np

from rasterloom.llm import secrets

KEY = "Zk3xQ9fLw7Rt2YbN8vHs4JdPm6KcGa1T"


def learned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.findings for r in secrets.scan_secrets(df).collect()}
    return [[t[f["start"] : f["end"]] for f in rows[i] if f["kind"] == "learned"] for i, t in enumerate(texts)]


def test_key_behind_a_long_path(spark):
    path = "https://hooks.example.com/services/integration/callbacks/v2/"
    texts = [f"post to {path}{KEY} now", f"post to {path}{path[8:]}{KEY}/and/more/of/the/path/behind/it now"]
    assert all(any(KEY in x for x in found) for found in learned(spark, texts))


def test_key_beside_a_fixed_finding(spark):
    text = f"see {KEY}/0123456789abcdef01234567/{KEY[::-1]} now"
    assert learned(spark, [text]) == [[f"{KEY}/", f"/{KEY[::-1]}"]]


def test_windows_cover_a_run():
    text = "a1" * 500
    starts = secrets.heads(text, 3, 990)
    assert starts[0] == 3 and starts[-1] == 990 - secrets.HEAD and max(b - a for a, b in zip(starts, starts[1:])) <= secrets.STEP


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (prefix, alphabet, length) of kinds that training does not know by name.
SECRETS = {
    "mixed 32": ("", LETTERS + DIGITS, 32), "mixed 20": ("", LETTERS + DIGITS, 20), "mixed 16": ("", LETTERS + DIGITS, 16), "lower 32": ("", LETTERS[:26] + DIGITS, 32), "letters 32": ("", LETTERS, 32), "letters 28": ("", LETTERS[26:], 28),
    "chat": ("xoxb-123456789012-345678901234-", LETTERS + DIGITS, 24), "maps": ("AIza", LETTERS + DIGITS + "-_", 35), "live": ("sk_live_", LETTERS + DIGITS, 24), "base32": ("", LETTERS[26:] + "234567", 32), "long": ("", LETTERS + DIGITS + "+/", 120), "upper hex": ("", DIGITS + "ABCDEF", 40),
}


def share_found(net, values, lead):
    texts = [f"please {lead}{v} and go on" for v in values]
    cases = [(t, s, e) for t in texts for s, _, e in secrets.candidates(t, [])]
    assert len(cases) == len(values)
    z = secrets.span_scores(net, cases)
    return np.mean([v >= net.levels[secrets.shape_of(t[s:e])] for v, (t, s, e) in zip(z, cases)])


def test_kinds_left_out_of_training():
    net, rng = secrets.trained_network(), np.random.default_rng(8)
    draw = lambda a, k: "".join(a[i] for i in rng.integers(0, len(a), k))
    for lead in ("see ", 'api_key_value "'):
        found = {kind: share_found(net, [prefix + draw(alphabet, k) for _ in range(150)], lead) for kind, (prefix, alphabet, k) in SECRETS.items()}
        assert np.mean(list(found.values())) > 0.97 and min(found.values()) > 0.9, found


def test_what_only_looks_long_is_no_secret():
    net, rng = secrets.trained_network(), np.random.default_rng(9)
    words = "get user account status handler process order item report annual config local share default timeout buffer index internal".split()
    some = lambda k: [words[i] for i in rng.integers(0, len(words), k)]
    kinds = {
        "uuid": lambda: str(uuid.UUID(bytes=rng.bytes(16), version=4)), "path": lambda: "usr/local/" + "/".join(some(3)), "snake": lambda: "_".join(some(5)), "camel": lambda: "".join(w.capitalize() for w in some(6)),
        "constant": lambda: "_".join(some(5)).upper(), "host": lambda: "www." + ".".join(some(2)) + ".com/" + "/".join(some(2)), "file": lambda: "-".join(some(3)) + "-2024.pdf",
    }
    for lead in ("see ", "key "):
        found = {kind: share_found(net, [f() for _ in range(200)], lead) for kind, f in kinds.items()}
        assert np.mean(list(found.values())) < 0.01 and max(found.values()) < 0.04, found


def test_time_grows_with_length_alone():
    import time

    began = time.time()
    assert len(secrets.candidates("a" * 1_000_000, [])) == 1 and secrets.base_spans("g" * 1_000_000) == []
    many = "0123456789abcdef01234567 " * 20_000
    base = secrets.base_spans(many)
    assert len(base) == 20_000 and secrets.candidates(many, base) == []
    assert time.time() - began < 2
