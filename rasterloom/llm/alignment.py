"""Cross-tokenizer alignment: a dictionary of the groups of A and B tokens that texts are made of.

A group is a stretch of a text between two places where tokens of both kinds end. Each task
interns its distinct groups, and gives for each chunk of documents their groups by number, the
groups themselves, and how many of the chunk's documents hold each pair of linked ids. Over all
chunks the distinct groups are expanded into links once; counts of pairs give each group its sums,
which are joined back to the chunks by the group's key, and a chunk's documents add them up.

Words between single spaces are cut alike in every text by both kinds of tokenizer, so a task
tokenizes a word once and remembers its groups.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.functions.workers import reach_workers

from . import common
from .bpe import byte_alphabet

#: Words a worker remembers and the characters of the longest; what it remembers is dropped between chunks when there are more.
WORDS, WORD_CHARS = 400_000, 64
#: A chunk ends with the document that brings it to so many distinct groups, summed over its documents.
CHUNK = 2_000_000
#: Characters of new words that are tokenized together.
TOGETHER = 100_000
#: Parts A ids from B ids in a group's key: no id has this value.
BAR = b"\xff\xff\xff\xff"
SPACE = "▁"

ROWS = "kind int, chunk long, id {id}, n_a long, n_b long, n_groups long, sha string, groups binary, times binary, no int, key binary, a int, b int, docs long"


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes of bytes, as small ones compress well so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def segments(text: str) -> list[str]:
    """A text cut at its single spaces between other characters, which both kinds of tokenizer cut at whatever is around them."""
    out, held = [], []
    for p in text.split(" "):
        if held and p and held[-1] and not p[0].isspace() and not held[-1][-1].isspace():
            out.append(" ".join(held))
            held = []
        held.append(p)
    out.append(" ".join(held))
    return out


def expand(lens_a: np.ndarray, lens_b: np.ndarray, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The links of one group in order: a pair for each overlap of an A token's bytes with a B token's."""
    ends_a, ends_b = np.cumsum(lens_a[a]), np.cumsum(lens_b[b])
    cuts = np.union1d(ends_a, ends_b)
    i, j = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return [(a[x], b[y]) for x, y in zip(i.tolist(), j.tolist())]


class Vocabularies:
    """Both tokenizers and the bytes of their tokens. A is byte-level, B has pieces with byte fallback."""

    def __init__(self, config: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(config)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: i for i, c in enumerate(byte_alphabet())}
        spec = json.loads(config)
        special = {t["id"] for t in spec["added_tokens"]}
        strings = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            self.bytes_a[i] = s.encode() if i in special else bytes(back[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lens_a, self.lens_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        #: No piece runs on over a space, so words are cut alike everywhere.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """A and B ids of a text, or None if either's bytes are not those of space + text."""
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return a, b


class Aligner:
    """Remembers words and interns groups and pairs; what it remembers changes speed alone."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, tuple | None] = {}
        self.numbers: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.texts: list[str] = []
        self.pairs: dict[tuple[int, int], int] = {}
        self.links: list[list[int]] = []

    def number(self, key_a: bytes, key_b: bytes) -> int:
        """A group's number; a new group is expanded into its distinct pairs."""
        key = key_a + BAR + key_b
        no = self.numbers.get(key)
        if no is None:
            no = self.numbers[key] = len(self.keys)
            a, b = np.frombuffer(key_a, "<u4").tolist(), np.frombuffer(key_b, "<u4").tolist()
            found = {(a[0], b[0])} if len(a) == len(b) == 1 else set(expand(self.v.lens_a, self.v.lens_b, a, b))
            self.keys.append(key)
            self.texts.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            self.links.append([self.pairs.setdefault(p, len(self.pairs)) for p in found])
        return no

    def align(self, texts: list[str], joined: str) -> list[tuple | None]:
        """(A tokens, B tokens, groups, their text) of each of ``texts``, which ``joined`` holds with spaces between; None where bytes differ."""
        ids = self.v.encode(joined)
        if ids is None:
            return [None] if len(texts) == 1 else [self.align([t], t)[0] for t in texts]
        a, b = (np.array(x, dtype=np.int64) for x in ids)
        ends_a, ends_b = np.cumsum(self.v.lens_a[a]), np.cumsum(self.v.lens_b[b])
        stops = np.cumsum([len(t.encode()) + 1 for t in texts])
        mark = np.zeros(stops[-1] + 1, dtype=bool)
        mark[ends_a] = True
        at_b = np.flatnonzero(mark[ends_b]) + 1
        mark[:] = False
        mark[ends_b] = True
        at_a = np.flatnonzero(mark[ends_a]) + 1
        last = np.searchsorted(ends_a[at_a - 1], stops) + 1
        if len(texts) > 1 and (ends_a[at_a[last - 1] - 1] != stops).any():  # a boundary that is none
            return [self.align([t], t)[0] for t in texts]
        raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        cut_a, cut_b = [0, *at_a.tolist()], [0, *at_b.tolist()]
        groups = [self.number(raw_a[4 * s : 4 * e], raw_b[4 * t : 4 * f]) for s, e, t, f in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        out, first = [], 0
        for stop in last.tolist():
            own = tuple(groups[first:stop])
            out.append((cut_a[stop] - cut_a[first], cut_b[stop] - cut_b[first], own, ";".join(map(self.texts.__getitem__, own))))
            first = stop
        return out

    def documents(self, texts: list[str | None]) -> list[list[tuple | None]]:
        """The segments of each text, aligned; a null or empty text has none."""
        get, found, wanted = self.words.get, [], {}
        for text in texts:
            if not text:
                found.append([])
                continue
            got = list(map(get, text.split(" "))) if self.v.cuts else [None]
            if None in got:  # new or odd words, or words whose bytes differ
                got = segments(text) if self.v.cuts else [text]
                wanted |= dict.fromkeys(w for w in got if w not in self.words)
            found.append(got)
        plain, held, size = {}, [], 0

        def settle():
            nonlocal held, size
            if held:
                plain.update(zip(held, self.align(held, " ".join(held))))
            held, size = [], 0

        for w in wanted:
            if not w or w[0].isspace() or w[-1].isspace() or len(w) > TOGETHER or not self.v.cuts:
                plain[w] = self.align([w], w)[0]
                continue
            held.append(w)
            size += len(w) + 1
            if size > TOGETHER:
                settle()
        settle()
        for i, got in enumerate(found):
            if got and any(type(x) is str for x in got):
                found[i] = [plain[w] if w in plain else self.words[w] for w in got]
        for w, x in plain.items():
            if x is not None and len(w) <= WORD_CHARS and not w[:1].isspace() and not w[-1:].isspace() and w:
                self.words[w] = x
        return found


#: A worker's aligner, kept from one task to the next, by the digest of its files.
_KEPT: dict[str, Aligner] = {}


def kept_aligner(config: str, model: bytes) -> Aligner:
    digest = hashlib.sha256(config.encode() + model).hexdigest()
    if digest not in _KEPT:
        _KEPT.clear()
        _KEPT[digest] = Aligner(Vocabularies(config, model))
    return _KEPT[digest]


class Chunk:
    """Documents of one chunk and the groups and pairs they hold."""

    def __init__(self, number: int):
        self.number, self.rows, self.groups, self.size = number, [], [], 0

    def add(self, doc, parts: list) -> None:
        none = np.zeros(0, dtype=np.int64)
        if not parts or any(p is None for p in parts):
            self.rows.append((doc, 0, 0, 0, "", none, none))
        else:
            groups = np.fromiter(chain.from_iterable(map(itemgetter(2), parts)), dtype=np.int64)
            sha = hashlib.sha256(";".join(map(itemgetter(3), parts)).encode()).hexdigest()
            distinct, times = np.unique(groups, return_counts=True)
            self.rows.append((doc, sum(map(itemgetter(0), parts)), sum(map(itemgetter(1), parts)), len(groups), sha, distinct, times))
        self.groups.append(self.rows[-1][5])
        self.size += len(self.groups[-1])

    def frame(self, aligner: Aligner) -> dict:
        """All rows of the chunk: its documents (kind 0), its groups (1) and its pairs (2)."""
        sizes = np.array([len(g) for g in self.groups])
        flat = np.concatenate(self.groups) if self.groups else np.zeros(0, dtype=np.int64)
        used = np.unique(flat)
        place = np.zeros(len(aligner.keys) + 1, dtype=np.int64)
        place[used] = np.arange(len(used))
        links = [aligner.links[g] for g in used.tolist()]
        width = np.array([len(x) for x in links], dtype=np.int64)
        ends, pairs = np.cumsum(width), np.array(list(chain.from_iterable(links)), dtype=np.int64)
        local = place[flat]
        many = width[local]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat((ends - width)[local], many)
        doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), many)
        n_pairs = len(aligner.pairs) + 1
        counts = np.bincount(np.unique(doc * n_pairs + pairs[at]) % n_pairs, minlength=n_pairs)
        held = np.flatnonzero(counts)
        names = list(aligner.pairs)
        n, g, p = len(self.rows), len(used), len(held)
        docs = list(zip(*self.rows)) if self.rows else [[]] * 7
        gone = lambda k: [None] * k
        delta = [pack(np.diff(x, prepend=0)) for x in docs[5]]
        return {
            "kind": [0] * n + [1] * g + [2] * p, "chunk": [self.number] * (n + g + p), "id": list(docs[0]) + gone(g + p),
            **{c: list(docs[k]) + gone(g + p) for k, c in enumerate(("n_a", "n_b", "n_groups", "sha"), 1)},
            "groups": delta + gone(g + p), "times": [pack(x) for x in docs[6]] + gone(g + p),
            "no": gone(n) + used.tolist() + gone(p), "key": gone(n) + [aligner.keys[k] for k in used.tolist()] + gone(p),
            "a": gone(n + g) + [names[k][0] for k in held.tolist()], "b": gone(n + g) + [names[k][1] for k in held.tolist()],
            "docs": gone(n + g) + counts[held].tolist(),
        }


def chunk_rows(docs: DataFrame, config, model, id_col: str, text_col: str) -> DataFrame:
    """Rows of all chunks, as ``Chunk.frame`` gives them."""

    def make():
        aligner, part = kept_aligner(config.value, model.value), TaskContext.get().partitionId()
        chunk = Chunk(part << 32)

        def flush():
            nonlocal chunk
            out = chunk.frame(aligner) if chunk.rows else None
            chunk = Chunk(chunk.number + 1)
            if len(aligner.words) > WORDS or len(aligner.keys) > WORDS:
                aligner.clear()
            return out

        def add(rows):
            for doc, parts in zip(rows[id_col], aligner.documents(rows[text_col])):
                chunk.add(doc, parts)
            if chunk.size > CHUNK or len(aligner.words) > 2 * WORDS or len(aligner.keys) > 2 * WORDS:
                return flush()
            return None

        return add, flush

    return common.map_tasks(docs, [id_col, text_col], ROWS.format(id=docs.schema[id_col].dataType.simpleString()), make)


def group_links(keys: DataFrame, config, model) -> DataFrame:
    """(key, a, b, times): the links of each distinct group, expanded once."""

    def make():
        v = kept_aligner(config.value, model.value).v

        def f(rows):
            out: dict[str, list] = {"key": rows["key"], "links": []}
            for key in rows["key"]:
                ids = np.frombuffer(key, "<u4")
                bar = int(np.flatnonzero(ids == 0xFFFFFFFF)[0])
                links = expand(v.lens_a, v.lens_b, ids[:bar].tolist(), ids[bar + 1 :].tolist())
                count: dict = {}
                for x in links:
                    count[x] = count.get(x, 0) + 1
                out["links"].append([{"a": a, "b": b, "times": n} for (a, b), n in count.items()])
            return out

        return f

    links = common.map_rows(keys, ["key"], "key binary, links array<struct<a:int,b:int,times:long>>", make)
    return links.select("key", F.explode("links").alias("x")).select("key", "x.a", "x.b", "x.times")


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each whole text under two tokenizers.

    ``a_path`` is a byte-level tokenizer file, ``b_path`` a model of pieces with byte fallback; both
    are read on the driver and broadcast, at their fixed size. Texts that are null, empty, or
    whose tokens' bytes differ from space + text get zeros and an empty digest. A pair's count is
    the number of documents (rows) that hold it linked; repeated rows count as documents of their own
    and stay repeated; null ids stay null. Very long texts are aligned whole. An empty table gives
    no rows; other columns are never read.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        config, model = spark.sparkContext.broadcast(f.read()), spark.sparkContext.broadcast(g.read())
    chunks = common.stored(chunk_rows(docs, config, model, id_col, text_col))
    groups = chunks.where("kind = 1").select("chunk", "no", "key")
    counts = chunks.where("kind = 2").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    counts = common.stored(counts)
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each A id at most: its size is the vocabulary's
    pairs = counts.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    links = common.stored(group_links(groups.select("key").distinct(), config, model))
    hot = common.frequent(links.groupBy("a", "b").count(), ["a", "b"], "count", links.count())
    sums = common.join_spread(links, pairs, ["a", "b"], hot).groupBy("key").agg(F.sum(F.col("times") * F.col("docs")).alias("count_sum"), F.sum(F.col("times") * F.col("best")).alias("n_best"))
    values = groups.join(sums, "key").select(F.col("chunk").alias("of"), "no", "n_best", "count_sum")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        no = right["no"].to_numpy()
        best, total = (np.zeros(int(no.max()) + 1 if len(no) else 1, dtype=np.int64) for _ in range(2))
        best[no], total[no] = right["n_best"].to_numpy(), right["count_sum"].to_numpy()
        own = [(np.cumsum(unpack(g), dtype=np.int64), unpack(t).astype(np.int64)) for g, t in zip(left["groups"].to_pylist(), left["times"].to_pylist())]
        n_a, n_b, n_groups = (left[c].to_numpy() for c in ("n_a", "n_b", "n_groups"))
        sums = [[int(x[g] @ t) for g, t in own] for x in (best, total)]
        return pa.table([left["id"], n_a, n_b, n_groups, n_a + n_b - n_groups, *sums, left["sha"]], schema=arrow)

    reach_workers(spark)
    rows = chunks.where("kind = 0").select("chunk", "id", "n_a", "n_b", "n_groups", "sha", "groups", "times")
    return rows.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(add_up, schema)
