"""The queries of the numbered operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, html_text, language, lexical, multi_index, near_dedup, packing, sharding, token_count, topk, unigram,
               variants, warc)
from .util import normalised, table


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_pages(pages, html_text.train(pages))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), packing.word_count("text"), source=F.col("source"),
                            cluster=F.xxhash64(normalised(F.col("text"))))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unigram.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"),
                      F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, [x for x in regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g
  FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
), c AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL
  SELECT DISTINCT 'q', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT side, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM t WHERE text IS NOT NULL
), d AS (
  SELECT id, term, count(*) AS tf FROM w WHERE side = 'd' GROUP BY 1, 2
), n AS (
  SELECT id, sum(tf)::BIGINT AS n FROM d GROUP BY 1
), c AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n
), f AS (
  SELECT term, count(*)::BIGINT AS df FROM d GROUP BY 1
), q AS (
  SELECT id AS item_id, term, count(*)::BIGINT AS times FROM w WHERE side = 'q' GROUP BY 1, 2
), s AS (
  SELECT q.item_id, d.id AS doc_id, sum(q.times * floor(1000 * ln((2 * c.docs + 2)::DOUBLE / (2 * f.df + 1)::DOUBLE))::BIGINT
           * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (100 - 75 + (75 * n.n * c.docs) // c.terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN d USING (term) JOIN n ON n.id = d.id CROSS JOIN c
  GROUP BY 1, 2
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.count_words(table(spark, sf_dir, "documents"), drop_every=31))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step
), t AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), r AS (
  SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM t WHERE length(run) >= 7 GROUP BY 1, 2
), b AS (
  SELECT run, n, list_transform(range(strlen(d || ':' || run)), lambda i: ('0x' || hex(d || ':' || run)[2 * i + 1:2 * i + 2])::BIGINT) AS bytes FROM r
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, crc
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || right(run, length(run) - 1 - h % length(run)) ELSE run END AS word, n FROM h
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
), x AS (
  SELECT word, n, i, left(word, i) || right(word, length(word) - 1 - i) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v) u
), p AS (
  SELECT DISTINCT x.word AS a, v.word AS b FROM x JOIN v ON x.rest = v.word UNION
  SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word UNION
  SELECT x.word, y.word FROM x JOIN x y ON x.i = y.i AND x.rest = y.rest AND length(x.word) = length(y.word) AND x.word <> y.word
), f AS (
  SELECT a AS word, count(*) AS n_near, min({'o': -v.n, 'w': b}) AS best FROM p JOIN v ON v.word = b GROUP BY 1
), g AS (
  SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN -f.best.o >= 10 * v.n THEN f.best.w END AS form,
         CASE WHEN -f.best.o >= 10 * v.n THEN -f.best.o END AS form_n FROM v LEFT JOIN f USING (word)
), chain(word, root) AS (
  SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM chain c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL
)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n
FROM g JOIN chain c ON c.word = g.word JOIN g e ON e.word = c.root AND e.form IS NULL
"""


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_token_count": op1_token_count,
    "op2_topk": op2_topk,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_sharding": op6_sharding,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_dedup": op10_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_nearest": op13_nearest,
}

SQL = {
    "op2_topk": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_near_dedup": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
