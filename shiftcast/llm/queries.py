"""One query per operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftcast.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors with cosine 0.9 or more, and their components."""
    from shiftcast.llm.neighbours import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows."""
    from shiftcast.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLE["op2_line_dedup"] = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS pos FROM l WHERE len(a) >= 3),
w AS (SELECT doc_id, pos, array_to_string(a[pos + 1 : pos + 3], chr(10)) AS k FROM p),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r
      FROM w WHERE regexp_matches(k, '[^ \t\r\n]')),
c AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM f WHERE r > 1),
n AS (SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS pos FROM l),
k AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.pos) FILTER (WHERE c.pos IS NULL) AS text,
             count(*) AS n_lines, count(c.pos) AS n_removed
      FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.pos = c.pos GROUP BY n.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""


@_query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have Jaccard >= 0.8."""
    from shiftcast.llm.jaccard import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


@_query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by its host's wrapper."""
    from shiftcast.llm.wrappers import main_text

    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet-matrix shards and read back."""
    from shiftcast.llm.wavelet import read_shards, write_shards

    shards = write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), scratch(spark, "wavelet"))
    return read_shards(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, and of every document (its source stands for the host), by all evidence there is."""
    from shiftcast.llm.language import document_records, identify, page_records, train

    docs = table(spark, sf_dir, "documents")
    records = page_records(table(spark, sf_dir, "pages")).unionByName(document_records(docs))
    out = identify(records, train(docs.select("text", "lang")))
    return out.select("kind", F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
                      F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "declared", "lang", "probability", "text_lang")


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, normalised to a gzip member each, and read back by the index."""
    from shiftcast.llm.warc import read_archives, write_archives

    archives = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer, one row per document and item."""
    from shiftcast.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of four fifths of the ids are learned from."""
    from shiftcast.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents' token ids in sequences of at most 2048."""
    from shiftcast.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First negatives of every fiftieth vector and each of its first positives."""
    from shiftcast.llm.negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND len(a.q) = len(b.q) AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT anchor_id, other AS positive_id, score AS positive_score,
                        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
              AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3
"""


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of two to four words of each language."""
    from shiftcast.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
word AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM numbered),
four AS (
  SELECT lang, w AS a, lead(w, 1) OVER x AS b, lead(w, 2) OVER x AS c, lead(w, 3) OVER x AS d
  FROM word WINDOW x AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS m, a AS p, count(*) AS f FROM four GROUP BY lang, p
  UNION ALL SELECT lang, 2, a || ' ' || b AS p, count(*) FROM four WHERE b IS NOT NULL GROUP BY lang, p
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c AS p, count(*) FROM four WHERE c IS NOT NULL GROUP BY lang, p
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d AS p, count(*) FROM four WHERE d IS NOT NULL GROUP BY lang, p),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, p, f, string_split(p, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (
  SELECT lang, p, m, f, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : m], ' ') AS rp
  FROM c CROSS JOIN (VALUES (1), (2), (3)) AS s(k) WHERE k < m),
cut AS (
  SELECT k.lang, k.p, k.f AS a, k.k, l.f AS l, r.f AS r, (2000000 * CAST(k.f AS HUGEINT)) // (l.f + r.f) AS score
  FROM k JOIN (SELECT lang || '/' || p AS key, f FROM f) AS l ON l.key = k.lang || '/' || k.lp
         JOIN (SELECT lang || '/' || p AS key, f FROM f) AS r ON r.key = k.lang || '/' || k.rp),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS x FROM cut) WHERE x = 1),
sub AS (
  SELECT lang, array_to_string(w[i : i + z - 1], ' ') AS p, f FROM (
    SELECT lang, w, f, z, unnest(range(1, m - z + 2)) AS i FROM c CROSS JOIN (VALUES (2), (3)) AS s(z) WHERE z < m)),
most AS (SELECT lang, p, max(f) AS f FROM sub GROUP BY 1, 2),
kept AS (SELECT w.* FROM worst w LEFT JOIN most ON most.lang = w.lang AND most.p = w.p WHERE most.f IS NULL OR 100 * most.f < 80 * w.a),
best AS (
  SELECT lang, p AS phrase, a, l, r, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT best.lang, rank, phrase, a, l, r, n, score FROM best JOIN n ON n.lang = best.lang WHERE rank <= 2000
"""


@_query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weight takes of every document."""
    from shiftcast.llm.mixing import plan_mix

    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE["op13_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(concat('42/', coalesce(CAST(doc_id AS VARCHAR), 'null'), '/', coalesce(text, ''))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, sum(size) AS words, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
r(i, rest, open) AS (
  SELECT 0, (SELECT sum(words) FROM s), (SELECT sum(weight) FROM s)
  UNION ALL
  SELECT i + 1, (SELECT sum(words) FROM s) - coalesce((SELECT sum(3 * words) FROM s WHERE 3 * words * r.open < r.rest * weight), 0),
         (SELECT sum(weight) FROM s WHERE 3 * words * r.open >= r.rest * weight) FROM r WHERE i < 50),
f AS (SELECT rest, open FROM r WHERE i = 50),
t AS (
  SELECT s.source, words, CASE WHEN 3 * words * open < rest * weight THEN CAST(3 * words AS DOUBLE)
                               ELSE CAST(rest * weight AS DOUBLE) / open END AS target,
         CASE WHEN 3 * words * open < rest * weight THEN 3 * words ELSE (rest * weight) // open END AS budget FROM s, f),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target,
       CAST(CASE WHEN words = 0 THEN 0 ELSE (budget // words) * size
                 + greatest(0, least(size, budget - (budget // words) * words - before)) END AS BIGINT) AS taken, o.source
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for k, v in ORACLE.items()}
