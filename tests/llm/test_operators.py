"""Text operators against brute force, round trips, held-out accuracy and awkward inputs."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontam, html_text, langid, linededup, nearjoin, quality, rules, secrets, sharding
from rasterloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, size string, shard string, line string, node string"


def texts(rows):
    return [(i, t, "x", "y", "z", "w") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts beside columns whose names clash."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, None), (None, "a null id with some words in it"), (2, ""), (3, "  \n \n"), (4, long), (5, long), (6, "same words here and now ok"), (6, "same words here and now ok"), (7, "żółw 漢字 🙂 token = \"abcdef123\""), (8, None)]
    return spark.createDataFrame(texts(rows), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_sharding(spark, docs, odd, none):
    for df, n in ((docs, 16), (odd, 3), (none, 4)):
        rows = sharding.balanced_shards(df, n).collect()
        assert len(rows) == df.count()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        if rows:
            counts = [len(by.get(s, ())) for s in range(n)]
            assert max(counts) - min(counts) <= 1
    rows = sharding.balanced_shards(docs.union(docs), 16).collect()
    split = Counter(len({r.shard for r in rows if r.doc_id == i}) for i in {r.doc_id for r in rows})
    assert split[1] > 0.9 * sum(split.values())


def test_sharding_splits_a_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "copy" if i < 40 else f"text {i}") for i in range(100)], "doc_id long, text string")
    rows = sharding.balanced_shards(df, 8).collect()
    assert max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1
    assert len({r.shard for r in rows if r.doc_id < 40}) <= 5


def test_language(spark, docs, odd):
    found = Q.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    train = docs.select("doc_id", "text", "lang")
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify_languages(odd, train).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= rows
    assert {r.lang_pred for r in langid.identify_languages(odd, train.limit(0)).collect()} == {"und"}


def brute_near(rows):
    sets = []
    for i, t in rows:
        w = decontam.words_of(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), str(least.get(find(k)) if s else i), links[k]) for k, (i, s) in enumerate(sets))


def test_near_join(spark, docs, odd, none, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    copies = []
    for k in range(60):  # a group with edits, compared in several small blocks
        w = list(base)
        w[rng.randrange(len(w))] = f"new{k}"
        copies.append((1000 + k, " ".join(w)))
    many = spark.createDataFrame(texts(copies), SCHEMA).union(odd)
    monkeypatch.setattr(nearjoin, "BLOCK", 16)
    monkeypatch.setattr(nearjoin, "BUCKET", 16)
    for df in (docs.select("doc_id", "text"), many):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        found = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in nearjoin.near_duplicates(df).collect())
        assert found == brute_near(rows)
    assert nearjoin.near_duplicates(none).count() == 0
    kept = nearjoin.keep_one(many)
    assert kept.columns == many.columns and kept.count() == 1 + 2 + 1 + 1 + 1 + 1 + 1 + 1


def test_secrets(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keyword = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for df in (docs, odd):
        source = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        rows = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
        for i, t in source:
            t = t or ""
            want = [(m.start(), 0, m.end()) for m in keyword.finditer(t) if len(m[2]) >= 6]
            want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
            want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
            assert [(f["start"], secrets.KINDS.index(f["kind"]), f["end"]) for f in rows[i].findings if f["kind"] != "learned"] == sorted(want)


def test_secret_network_held_out():
    net = secrets.trained_network()
    cases, y = secrets.labelled_findings(1000, seed=77)
    import numpy as np

    z = secrets.span_scores(net, cases)
    hit = np.array([v >= net.levels[secrets.shape_of(t[s:e])] for v, (t, s, e) in zip(z, cases)])
    assert hit[y == 1].mean() > 0.95 and hit[y == 0].mean() < 0.02
    p = net.probability(z)
    for low, high in ((0, 0.2), (0.8, 1.01)):  # probabilities mean what they say
        near = (p >= low) & (p < high)
        assert abs(y[near].mean() - p[near].mean()) < 0.1


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path()
    theirs, mine = Tokenizer.from_file(path), bpe.WordBpe(bpe.read_config(path))
    rng = random.Random(1)
    alphabet = "aàÀΣςİıſ'sS tT're 12½² ́\u0085\x1c\n\t漢字🙂🏽é#$%<|endoftext|>_-—"
    for k in range(2000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) + "<|endoftext|>" * (k % 7 == 0)
        want = theirs.encode(x, add_special_tokens=False).ids
        ids, decoded = mine.encode(x)
        assert ids == b"".join(i.to_bytes(4, "little") for i in want)
        assert decoded == theirs.decode(want, skip_special_tokens=False) == mine.decode(ids)
    rows = bpe.bpe_encode(odd, path).collect()
    assert len(rows) == odd.count() and {len(r.ids) for r in rows if r.doc_id in (1, 2, 3, 8)} == {0}


def test_decontamination(spark, docs, odd, none, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text").union(spark.createDataFrame([("short", "Words HERE and"), ("none", None), ("dots", "...")], "item_id string, text string"))
    items = [(r.item_id, re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower())) for r in bench.collect()]
    for most in (decontam.MOST_WINDOWS, 0):  # by a broadcast, and by a join
        for df in (docs, odd):
            rows = decontam.contamination(df, bench, most=most).collect()
            assert len(rows) == df.count()
            source = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
            for r in rows:
                w = re.findall(rb"[0-9a-z\x80-\xff]+", (source[r.doc_id] or "").encode().lower())
                hit, found = set(), set()
                for item, x in items:
                    for k in range(max(1, len(x) - 9) if x else 0):
                        g = x[k : k + 10]
                        for at in range(len(w) - len(g) + 1):
                            if w[at] == g[0] and w[at : at + len(g)] == g:
                                hit.update(range(at, at + len(g)))
                                found.add(item)
                assert (r.n_words, r.hit, r["items"]) == (len(w), sorted(hit), sorted(found))
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where(F.size("hit") > 0).count() == 0
    leaks = spark.createDataFrame(texts([(None, "x words here AND, y"), (7, "words here and"), (7, "nothing of it"), (None, "clean"), (9, None)]), SCHEMA)
    for most in (decontam.MOST_WINDOWS, 0):
        kept = decontam.decontaminate(leaks, bench.where("item_id = 'short'"), most)
        assert kept.columns == leaks.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == ["(7, 'nothing of it')", "(9, None)", "(None, 'clean')"]


def test_html():
    f = html_text.html_to_text
    assert f(None) == f("") == f("<script>x</script><p hidden>y</p>") == ""
    assert f("<ul><li>a<li>b<ol start=3><li>c</ol></ul>") == "- a\n- b\n  3. c"
    assert f("<table><tr><th>x<th>yy<tr><td>1 1<td>2</table>") == "x    yy\n1 1  2"
    assert f("<p>a<p style='display : none'>b<div>c &amp; d</div>e<br>f") == "a\n\nc & d\ne\nf"
    assert f("<pre> a\n  b</pre>") == " a\n  b"
    assert f("<![weird <b>x" + "<div>" * 5000 + "deep") .endswith("deep")


def test_html_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = html_text.extract_text(pages).collect()
    assert len(rows) == pages.count() and all("<" not in r.text for r in rows)


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = Q.op8_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) > 0.95 * len(found)
    assert all(r.predicted == 1 for r in found if r.quality == 1)
    assert quality.quality_scores(odd, labels).count() == odd.count() and quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {1.0}
    kept = quality.quality_filter(odd, labels)
    assert kept.columns == odd.columns
    good = docs.where("doc_id IS NOT NULL").join(labels_of(spark).where("quality = 1"), "doc_id").select("text").first().text
    same = spark.createDataFrame(texts([(i, t) for i in (None, 5) for t in (good, "! | # !! |")]), SCHEMA)
    both = docs.select("doc_id", "text").unionByName(same, allowMissingColumns=True)
    scores = quality.quality_scores(both, labels_of(spark))
    bad = {(r.doc_id, r.text_key) for r in scores.where("predicted = 0").collect()}
    found = quality.quality_filter(both, labels_of(spark)).select("doc_id", F.xxhash64("text").alias("k")).collect()
    assert len(found) == scores.where("predicted = 1").count() and not bad & {(r.doc_id, r.k) for r in found} and bad


def test_hash_sample_of_a_large_table(spark):
    from rasterloom.llm import common

    df = spark.range(0, 20_000, 1, 7).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    assert sorted(r.doc_id for r in common.hash_sample(df, "doc_id", 300).collect()) == sorted(want)
    assert common.hash_sample(df.limit(0), "doc_id", 300).count() == 0 and common.hash_sample(df.limit(5), "doc_id", 300).count() == 5


def brute_line_dedup(rows):
    lines = [(i is not None, i, no, t) for i, text in rows if text is not None for no, t in enumerate(text.split("\n"))]
    seen, gone = [], set()
    for _, i, no, t in sorted(lines, key=lambda x: (x[0], x[1] or 0, x[2])):
        s = {w for w in re.split("[ \t\x0b\x0c\r]+", t) if w}
        if s:
            if any(5 * len(s & x) >= 4 * len(s | x) for x in seen):
                gone.add((i, no))
            seen.append(s)
    return gone


def test_line_dedup(spark, docs, odd, none):
    few = docs.select("doc_id", "text").orderBy("doc_id").limit(60)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(30)]
    more = spark.createDataFrame([(9000 + k, "\n".join([" ".join(base[:k % 25] + [f"e{rng.randrange(5)}"] + base[k % 25 + 1 :]), "short line", "a  b c d e"])) for k in range(40)], "doc_id long, text string")
    df = few.union(more)
    gone = brute_line_dedup([(r.doc_id, r.text) for r in df.collect()])
    out = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    for r in df.collect():
        kept = [t for no, t in enumerate(r.text.split("\n")) if (r.doc_id, no) not in gone]
        assert out[r.doc_id].text == "\n".join(kept) and out[r.doc_id].n_removed == len(r.text.split("\n")) - len(kept)
    rows = linededup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and [r.text for r in rows if r.doc_id in (1, 8)] == [None, None]
    assert [r.n_removed for r in rows if r.doc_id == 5] == [1] and [r.n_removed for r in rows if r.doc_id == 6] == [0, 0]
    assert linededup.dedup_lines(none).count() == 0


def test_rules(spark, docs, odd, none):
    labels = labels_of(spark)
    for df in (docs, odd):
        source = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in rules.quality_rules(df, labels).collect():
            t = source[r.doc_id]
            w = re.findall("[^\x20\x09-\x0d]+", t)
            grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
            lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
            assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
            assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(none, labels).count() == 0


def test_trees_are_monotone():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=2000) < 0.3).astype(float)
    model = rules.grow_trees(x, y, [0])
    for row in x[:50]:
        line = np.repeat(row[None, :], 40, axis=0)
        line[:, 0] = np.linspace(-3, 3, 40)
        assert (np.diff(model.score(line)) <= 1e-12).all()
    assert ((model.score(x) > 0.5) == y).mean() > 0.8


def test_digests(spark):
    r = Q.op4_secret_scan(spark, "/root/testdata/sf0.01").where("spans <> ''").first()
    base = ",".join(s for s in r.spans.split(",") if not s.startswith("learned"))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
