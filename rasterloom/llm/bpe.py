"""Byte-pair encoding with word ends, by a priority queue of merges over a linked symbol list."""

from __future__ import annotations

import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame

from . import common

# The vocabulary's split pattern and its special tokens' place in the file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CHUNKS = regex.compile(r"\S+")
END = "</w>"
#: Stands for a symbol that was merged into the one before it.
GONE = (1 << 20) - 1
#: Entries kept in each of a task's two caches, and the characters of the longest; a full cache is emptied.
CACHE, CACHED = 300_000, 64


def byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable Latin-1 stays, the rest follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one tokenizer file of the kind ``word_bpe``."""

    def __init__(self, config: str):
        spec = json.loads(config)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: (r, self.vocab[a + b]) for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.strings = {i: s for s, i in self.vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.strings |= {i: s for s, i in special.items()}
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = {self.vocab[c]: self.vocab[c + END] for c in alphabet}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-tokenised word.

        Queue entries are rank * length + position. An entry is stale, and skipped, if its left
        symbol is gone or the pair now standing there has another rank.
        """
        symbols = [self.first[b] for b in word.encode("utf-8", "replace")]
        n = len(symbols)
        symbols[-1] = self.last[symbols[-1]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        queue = [m[0] * n + i for i in range(n - 1) if (m := merges.get(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            if j >= n or (m := merges.get(symbols[i] << 20 | symbols[j])) is None or m[0] != r:
                continue
            symbols[i] = m[1]
            symbols[j] = GONE
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if m := merges.get(symbols[i] << 20 | symbols[k]):
                    heapq.heappush(queue, m[0] * n + i)
            h = before[i]
            if h >= 0 and (m := merges.get(symbols[h] << 20 | symbols[i])):
                heapq.heappush(queue, m[0] * n + h)
        return tuple(s for s in symbols if s != GONE)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            ids = self.merge(word)
            if len(word) <= CACHED:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids and decoded tokens of a run without white space."""
        lowered = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        ids = [i for piece in PIECES.findall(lowered) for i in self._word(piece)]
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        out = (b"".join(i.to_bytes(4, "little") for i in ids), " ".join(self.strings[i] for i in ids))
        if len(chunk) <= CACHED:
            self.chunks[chunk] = out
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Little-endian 32-bit ids of a whole text, and their decoding."""
        parts = self.splitter.split(text) if self.splitter and "<|" in text else [text]
        ids: list[bytes] = []
        strings: list[str] = []
        for part in parts:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                strings.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            for chunk in CHUNKS.findall(part):
                found = self.chunks.get(chunk) or self._chunk(chunk)
                ids.append(found[0])
                strings.append(found[1])
        return b"".join(ids), " ".join(s for s in strings if s)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined by spaces as the file names no decoder."""
        return " ".join(self.strings[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))


def read_config(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", digest=None, schema: str | None = None) -> DataFrame:
    """Encode every whole text: doc_id, ids (array of ints), decoded.

    ``path`` is a file on the driver, read once and shipped as a broadcast of fixed size. Null
    texts are empty and give no ids; very long texts are encoded whole, long words outside the
    caches; repeated rows stay repeated; an empty table gives no rows. ``digest(ids, decoded)`` with
    ``schema`` replaces the two columns by what it returns (a dict), for callers that want a
    summary and not the tokens themselves.
    """
    config = docs.sparkSession.sparkContext.broadcast(read_config(path))

    def plain(ids, decoded):
        return {"ids": [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)], "decoded": decoded}

    def make():
        coder = WordBpe(config.value)
        give = digest or plain

        def f(rows):
            out = [give(*coder.encode(t or "")) for t in rows[text_col]]
            return {id_col: rows[id_col]} | {c: [o[c] for o in out] for c in (out[0] if out else give(b"", ""))}

        return f

    return common.map_rows(docs, [id_col, text_col], f"{id_col} long, " + (schema or "ids array<int>, decoded string"), make)
