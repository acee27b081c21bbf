"""Cross-tokenizer alignment against a plain computation over whole texts, and awkward inputs."""

import hashlib
from collections import defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rasterloom.llm import alignment, queries as Q

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, chunk long, kind int"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(docs):
    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    chars = {c: b for b, c in enumerate(alignment.byte_alphabet())}
    out, held = [], defaultdict(int)
    for i, text in docs:
        a = b = []
        if text:
            whole = (" " + text).encode()
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ab = [bytes(chars[c] for c in tok.id_to_token(x)) for x in a]
            bb = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(ab) != whole or b"".join(bb) != whole:
                a = b = []
        links, groups, x, y, at_a, at_b, first = [], [], 0, 0, 0, 0, (0, 0)
        while x < len(a):
            links.append((a[x], b[y]))
            end_a, end_b = at_a + len(ab[x]), at_b + len(bb[y])
            if end_a <= end_b:
                x, at_a = x + 1, end_a
            if end_b <= end_a:
                y, at_b = y + 1, end_b
            if at_a == at_b:
                groups.append(",".join(map(str, a[first[0] : x])) + "|" + ",".join(map(str, b[first[1] : y])))
                first = (x, y)
        for p in set(links):
            held[p] += 1
        out.append((i, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((i, n, m, len(g), len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), digest(g)) for i, n, m, g, k in out), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    odd = ["", None, " ", "  two  spaces ", "\n\nlines\r\n of \t tabs and　wide \x1c x", "a▁b and c", "<s> <|endoftext|> <0x41>", "\x00 nul", "漢字 かな 🙂🏽 é ﬁ", "don't 'tis ' s", "x" * 5000, " " * 3000 + "end",
           "word " * 20_000, "1234567890" * 300, "a \n b", "trailing ", "same same", "same same", "Ünïcödé zażółć"]
    return docs + [(5000 + i, t) for i, t in enumerate(odd)] + [(None, "a null id"), (5000, "repeated id"), (5000, "repeated id")]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_whole_text_tokenization(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    want = brute(rows)
    assert found(alignment.align_documents(df, *PATHS)) == want
    monkeypatch.setattr(alignment, "CHUNK", 500)  # many chunks, which forget their words
    monkeypatch.setattr(alignment, "WORDS", 300)
    assert found(alignment.align_documents(df, *PATHS)) == want
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0


def test_query_has_a_row_for_each_document(spark):
    got = Q.op12_token_alignment(spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(got) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
