"""One query per operator over the whole of its tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed, html_main, lines, lm, minhash, mixing, quality, search, tokens, toxicity, warc, whiten
from .jobs import id_crc_mod, read

#: The unigram vocabulary of op6; another file may be named in the environment.
VOCABULARY = "UNIGRAM_VOCABULARY"


def vocabulary_path() -> str:
    if VOCABULARY in os.environ:
        return os.environ[VOCABULARY]
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "piece_bpe_32k.model")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    graded = labels.select("doc_id", quality.grade_column(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.grade(read(spark, sf_dir, "documents"), graded, 3, held_out=id_crc_mod("doc_id", 5) == 0)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_embeddings(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(read(spark, sf_dir, "documents"), held_out=id_crc_mod("doc_id", 7) == 2)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokens.read_vocabulary(vocabulary_path()))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels, held_out=id_crc_mod("doc_id", 5) == 0).drop("text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read(spark, sf_dir, "embeddings"))


def op12_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"), payloads=False).drop("url", "payload")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_quality_grades, op3_embedding_dedup, op4_lm_scores, op5_line_dedup, op6_token_counts, op7_source_mix, op8_decontaminate, op9_main_text, op10_toxicity, op11_whitening, op12_warc_packages, op13_lexical_search)}

COMPONENTS = """
reach(a, b) AS (
  SELECT id, id FROM node
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

#: crc32 of a text of ASCII characters, bit by bit.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split({x}, '')]),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)))"""

SQL = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
node AS (SELECT DISTINCT doc_id AS id FROM documents), {COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp c ON c.id = d.doc_id""",
    "op3_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
node AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS}
SELECT n.id AS vec_id, (SELECT count(*) FROM link l WHERE l.a = n.id)::BIGINT AS n_links, c.component_id, n.id = c.component_id AS kept
FROM node n JOIN comp c ON c.id = n.id""",
    "op4_lm_scores": rf"""
WITH d AS (
  SELECT doc_id, {CRC32.format(x="doc_id::VARCHAR")} % 7 = 2 AS held_out,
    [' '] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' '] AS ws FROM documents
), t AS (SELECT doc_id, held_out, unnest([{{'g': CASE WHEN i > 2 THEN ws[i - 2] END, 'h': ws[i - 1], 'w': ws[i]}} for i in range(2, len(ws) + 1)]) AS x FROM d),
k AS (SELECT doc_id, held_out, x.g, x.h, x.w FROM t),
c1 AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w),
c2 AS (SELECT h, w, count(*) AS c FROM k WHERE NOT held_out GROUP BY h, w),
c3 AS (SELECT g, h, w, count(*) AS c FROM k WHERE NOT held_out AND g IS NOT NULL GROUP BY g, h, w),
s AS (SELECT (SELECT sum(c) FROM c1) AS n, (SELECT count(*) FROM c1) AS v),
p AS (
  SELECT k.doc_id, k.held_out, k.g IS NOT NULL AS long, coalesce(a.c, 0) AS a, coalesce(b.c, 0) AS b, coalesce(f.c, 0) AS f, coalesce(e.c, 0) AS e, coalesce(j.c, 0) AS j, (coalesce(a.c, 0) + 1) / (s.n + s.v + 1)::DOUBLE AS p1, s.n
  FROM k CROSS JOIN s LEFT JOIN c1 a ON a.w = k.w LEFT JOIN c1 f ON f.w = k.h LEFT JOIN c2 b ON b.w = k.w AND b.h = k.h
  LEFT JOIN c3 e ON e.w = k.w AND e.h = k.h AND e.g = k.g LEFT JOIN c2 j ON j.w = k.h AND j.h = k.g
), q AS (SELECT *, (b + 300.0::DOUBLE * p1) / (f + 300.0::DOUBLE) AS p2 FROM p)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE a > 0) AS n_known, max(n)::BIGINT AS train_tokens,
  round(sum(log10(p1)), 6) AS base_score, round(sum(log10(CASE WHEN long THEN (e + 10.0::DOUBLE * p2) / (j + 10.0::DOUBLE) ELSE p2 END)), 6) AS score
FROM q GROUP BY doc_id, held_out""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), k AS (
  SELECT doc_id, site, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key,
    regexp_matches(line, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){3}[^\x20\x09-\x0D]')
      OR regexp_matches(line, '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}][^\n]*?){4}') AS long FROM l
), s AS (SELECT key, min((doc_id, pos)) AS first FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= CASE WHEN bool_or(long) THEN 3 ELSE 6 END),
f AS (SELECT k.*, s.key IS NOT NULL AND (k.doc_id, k.pos) <> s.first AS gone FROM k LEFT JOIN s ON s.key = k.key),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '') AS t FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n, 0)::INTEGER AS lines_removed, length(coalesce(o.t, d.text))::BIGINT AS n_chars, md5(coalesce(o.t, d.text)) AS text_md5
FROM documents d LEFT JOIN o USING (doc_id)""",
    "op12_warc_packages": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1)::INTEGER, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM q""",
    "op13_lexical_search": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT *, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
f AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
v AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f CROSS JOIN s GROUP BY w, n_docs),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT i.item_id, d.r, d.doc_id, sum(v.weight * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * d.n * s.n_docs) // s.n_terms))))::BIGINT AS score
  FROM i JOIN v ON v.w = i.w JOIN f ON f.w = i.w JOIN d ON d.r = f.r CROSS JOIN s GROUP BY i.item_id, d.r, d.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20""",
}
