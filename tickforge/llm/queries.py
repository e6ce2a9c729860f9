"""The registered queries of the text operators, over whole tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical_search import lexical_search
from .line_dedup import line_dedup
from .mixing import mix_sources
from .mpeg import text_media
from .ngram_join import near_components
from .pieces import round_trip
from .quality import COUNTS, quality
from .sharding import shard_ring
from .substring_dedup import substring_dedup
from .token_alignment import align_tokens
from .token_counts import token_counts
from .toxicity import fit_toxicity, fold, toxicity
from .warc import archive_pages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file; pass another path to the operators to use another."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL["op2_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, a, array_to_string(w[a:a + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS a FROM words)
), firsts AS (
  SELECT k, min(doc_id) AS least FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, a + j AS p FROM (SELECT w.doc_id, w.a FROM windows w JOIN firsts f ON f.k = w.k AND f.least < w.doc_id), range(0, 50) t(j)
), placed AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words
), marked AS (
  SELECT p.*, g.p IS NOT NULL AS gone FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.p = p.p
), counted AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN counted c ON c.doc_id = w.doc_id
"""


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs)


ORACLE_SQL["op3_source_mix"] = """
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source
  HAVING sum(strlen(coalesce(text, ''))) > 0
), rates AS (
  SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) * (SELECT sum(size) FROM sizes)::DOUBLE / size::DOUBLE AS rate FROM sizes
), terms AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates
), probs AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM terms
), cdf AS (
  SELECT source, list(c ORDER BY k) AS c FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM probs) GROUP BY source
), counted AS (
  SELECT d.doc_id, d.source, d.text,
    len(list_filter(c.c, lambda x: x <= ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0))::INT AS n_copies
  FROM documents d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
), copies AS (
  SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1))::INT AS copy FROM counted WHERE n_copies >= 1
)
SELECT doc_id, source, text, n_copies, copy,
  ('0x' || substr(md5('mix-1-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 13))::BIGINT AS shuffle_key
FROM copies
"""


@query
def op4_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


@query
def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op6_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE_SQL["op6_warc_pages"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), k AS (
  SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM k
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality(docs, keep_text=False).select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance", "group_level")


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=3, limit="0.9")


ORACLE_SQL["op8_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[a:a + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS a FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * same >= 90 * (m.n + n.n - same)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.least AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return line_dedup(docs, min_chars=40, min_docs=5).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL["op9_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ring(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def ring_sql(shards: int = 8, vnodes: int = 64, slots: int = 4096) -> str:
    """One round after another: rows ask the next open shard clockwise; each shard takes rows in the order of their second hash."""
    key = "coalesce(doc_id::VARCHAR, 'null')"
    bits = lambda name: f"('0x' || substr(md5('{name}|' || {key}), 1, 13))::BIGINT"
    order = "ord, doc_id, text_crc32, size"
    parts = [f"""WITH bytes_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), coded AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
), rest0 AS MATERIALIZED (
  SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
    {bits("ring-place")} % {slots} AS place, {bits("ring-order")} AS ord FROM coded, bytes_table
), points AS MATERIALIZED (
  SELECT s AS shard, ('0x' || substr(h, 1, 8))::BIGINT % {slots} AS at, substr(h, 9, 8) AS tie FROM (SELECT s, md5('shard-' || s || '-' || v) AS h FROM range({shards}) a(s), range({vnodes}) b(v))
), room0 AS (
  SELECT s AS shard, n // {shards} + (s < n % {shards})::INT AS room FROM range({shards}) a(s), (SELECT count(*) AS n FROM rest0)
)"""]
    for k in range(shards):
        parts.append(f"""owners{k} AS (
  SELECT g AS place, arg_min(p.shard, (p.at < g, p.at, p.tie, p.shard)) AS shard FROM range({slots}) a(g), points p JOIN room{k} r ON r.shard = p.shard AND room > 0 GROUP BY g
), ranked{k} AS MATERIALIZED (
  SELECT x.*, o.shard, row_number() OVER (PARTITION BY o.shard ORDER BY {order}) <= room AS fits FROM rest{k} x JOIN owners{k} o USING (place) JOIN room{k} r ON r.shard = o.shard
), room{k + 1} AS MATERIALIZED (
  SELECT r.shard, room - (SELECT count(*) FROM ranked{k} x WHERE fits AND x.shard = r.shard) AS room FROM room{k} r
), rest{k + 1} AS MATERIALIZED (SELECT doc_id, size, text_crc32, place, ord FROM ranked{k} WHERE NOT fits)""")
    placed = " UNION ALL ".join(f"SELECT doc_id, size, text_crc32, ord, shard FROM ranked{k} WHERE fits" for k in range(shards))
    return ", ".join(parts) + f"""
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY {order}) - 1 AS slot,
  NULL::INT AS grown_shard FROM ({placed})"""


ORACLE_SQL["op10_ring_shards"] = ring_sql()


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE_SQL["op13_lexical_search"] = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), found AS (
  SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM found GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS total, sum(n)::BIGINT AS length FROM sizes
), weights AS (
  SELECT t, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM found GROUP BY t), corpus
), scales AS (
  SELECT doc_id, 25 + (75 * n * total) // length AS m FROM sizes, corpus
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
  ) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN found USING (t) JOIN scales USING (doc_id) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
