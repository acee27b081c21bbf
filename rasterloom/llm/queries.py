"""One query for each text operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, decontam, html_text, langid, lexical, linededup, nearjoin, quality, rules, secrets, sharding, vectors
from .common import crc_mod, map_rows, table

#: Where the tokenizer files are, unless a caller names another place.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.balanced_shards(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    train = docs.select("doc_id", "text", "lang").where(~held & F.col("doc_id").isNotNull())
    found = langid.identify_languages(docs, train)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def f(rows):
        out = {"doc_id": rows["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for spans in rows["findings"]:
            base = [x for x in spans if x["kind"] != "learned"]
            for kind in ("assign", "access", "hex"):
                out[f"n_{kind}"].append(sum(x["kind"] == kind for x in base))
            out["base_sha256"].append(secrets.sha256(secrets.span_list(base).encode()))
            out["spans"].append(secrets.span_list(spans))
        return out

    return map_rows(found, ["doc_id", "findings"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", lambda: f)


def bpe_digest(ids: bytes, decoded: str) -> dict:
    return {"n_tokens": len(ids) // 4, "ids_sha256": secrets.sha256(ids), "decoded_sha256": secrets.sha256(decoded.encode("utf-8", "surrogatepass"))}


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), digest=bpe_digest, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP6_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM items, unnest(generate_series(1, greatest(1, len(w) - 9))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
placed AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM docs, sizes, unnest(generate_series(1, len(w) - n + 1)) t(i)),
found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM placed p JOIN windows x ON p.n = x.n AND p.s = x.s),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(generate_series(0, n - 1)) t(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP9_SQL = r"""
WITH cuts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i AS no, ls[i] AS line FROM cuts, unnest(generate_series(1, len(ls))) t(i)),
sets AS (SELECT doc_id, no, line, list_distinct(list_filter(regexp_split_to_array(line, '[ \t\x{0B}\x{0C}\r]+'), lambda v: v <> '')) AS w FROM lines),
firsts AS (SELECT line, min((doc_id, no)) AS at, any_value(w) AS w, len(any_value(w)) AS n FROM sets WHERE len(w) > 0 GROUP BY line),
tokens AS (SELECT line, n, unnest(w) AS t FROM firsts),
freq AS (SELECT t, count(*) AS f FROM tokens GROUP BY t),
ranked AS (SELECT line, n, t, row_number() OVER (PARTITION BY line ORDER BY f, t) AS r FROM tokens JOIN freq USING (t)),
prefix AS (SELECT line, t FROM ranked WHERE r <= n - ((4 * n + 4) // 5) + 1),
pairs AS (SELECT DISTINCT a.line AS x, b.line AS y FROM prefix a JOIN prefix b ON a.t = b.t AND a.line <> b.line),
late AS (SELECT DISTINCT p.x FROM pairs p JOIN firsts a ON a.line = p.x JOIN firsts b ON b.line = p.y
  WHERE b.at < a.at AND 5 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
gone AS (SELECT s.doc_id, s.no FROM sets s JOIN firsts f ON f.line = s.line WHERE (s.doc_id, s.no) <> f.at OR s.line IN (SELECT x FROM late)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS text, count(*) AS n FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id)
SELECT c.doc_id, CAST(len(c.ls) AS BIGINT) AS n_lines, CAST(len(c.ls) - coalesce(k.n, 0) AS BIGINT) AS n_removed, coalesce(k.text, '') AS text
FROM cuts c LEFT JOIN kept k USING (doc_id)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS t FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS t FROM benchmark),
sums AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs),
asked AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(t) AS term FROM items) GROUP BY ALL),
held AS (SELECT row, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row, len(t) AS n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, sums GROUP BY term),
parts AS (SELECT row, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS part FROM held, sums),
scores AS (SELECT item, row, CAST(sum(w * part * times) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY item, row),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores JOIN docs USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 20
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM rows WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.93 END),
reach AS (SELECT r AS a, r AS b FROM rows UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lows AS (SELECT reach.a AS r, min(rows.vec_id) AS component_id FROM reach JOIN rows ON rows.r = reach.b GROUP BY reach.a),
sums AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM rows JOIN lows USING (r) LEFT JOIN sums USING (r)
"""


def queries() -> dict:
    found = (op1_sharding, op2_language_id, op3_near_join, op4_secret_scan, op5_bpe, op6_decontamination, op7_html_text, op8_quality, op9_line_dedup, op10_quality_rules, op11_lexical_search, op12_token_alignment, op13_embedding_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op9_line_dedup": OP9_SQL, "op11_lexical_search": OP11_SQL, "op13_embedding_dedup": OP13_SQL}
