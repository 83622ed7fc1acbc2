"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspan.llm import (
    collocations, decontamination, exact_dedup, language, mixing, near_join, prefix_trie, quality, repeats, sharding,
    token_counts, toxicity, warc,
)
from longspan.llm.common import documents, held_out_row
from longspan.plans.common import Registry

R = Registry()

EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER best AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept,
  sha256(norm) AS text_sha256
FROM d
WINDOW best AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
"""


@R.query("op10_exact_dedup", EXACT_SQL)
def exact(spark, folder):
    return exact_dedup.exact_groups(documents(spark, folder))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('0:' || doc_id) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    AS level
  FROM w
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken,
  source
FROM p
"""


@R.query("op5_mix_sources", MIX_SQL)
def mix(spark, folder):
    return mixing.mix(documents(spark, folder))


@R.query("op3_ring_shards")
def shards(spark, folder):
    placed = sharding.shard_documents(documents(spark, folder), 40)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, h, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""


@R.query("op6_warc_chunks", WARC_SQL)
def archives(spark, folder):
    return warc.round_trip(spark.read.parquet(f"{folder}/pages.parquet"))


CONTEXT_LIMITS = tuple(2**i for i in range(7, 21))


@R.query("op1_token_histogram")
def token_histogram(spark, folder):
    lengths = token_counts.encoded_lengths(documents(spark, folder))
    return token_counts.length_table(lengths, limits=CONTEXT_LIMITS)


@R.query("op7_toxicity_compression")
def toxic(spark, folder):
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.withColumns({
        "held_out": held_out_row(), "predicted": (F.col("score") >= 0.3).cast("int"),
    })


@R.query("op8_language_paths")
def languages(spark, folder):
    docs = documents(spark, folder)
    found = language.identify(docs, language.fit(docs), spans=True)
    return found.select("doc_id", held_out_row().alias("held_out"), "lang_pred", "score", "spans")


@R.query("op9_spaced_seeds")
def benchmark_passages(spark, folder):
    return decontamination.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@R.query("op4_jaccard_bayes")
def near_copies(spark, folder):
    return near_join.near_duplicates(documents(spark, folder))


@R.query("op2_column_suffixes")
def without_repeats(spark, folder):
    return repeats.remove_repeats(documents(spark, folder))


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(length(conv_id::VARCHAR)),
        lambda i: ascii(substr(conv_id::VARCHAR, i::INT + 1, 1))::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
        lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h
), d AS (
  SELECT conv_id, length(text) AS points,
    row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth,
    string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY part, place) AS path
  FROM r
), p AS (
  SELECT conv_id, points, depth, md5(path) AS node, lag(md5(path), 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS above
  FROM d
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
), n AS (
  SELECT node, depth, any_value(above) AS above, any_value(points) AS points, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM p GROUP BY node, depth
), k AS (
  SELECT above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above
), e AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id) GROUP BY node
), v AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * points AS saved
  FROM n LEFT JOIN k ON k.above = n.node
), s AS (
  SELECT a.node, sum(v.saved) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM (SELECT DISTINCT a.node, b.node AS under FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth) a
  JOIN v ON v.node = a.under GROUP BY a.node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN s USING (node) LEFT JOIN e USING (node) LEFT JOIN n q ON q.node = v.above
"""


@R.query("op11_prefix_trie", TRIE_SQL)
def prefixes(spark, folder):
    return prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


COLLOCATION_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), o AS (
  SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS i
  FROM (SELECT lang, words, row_number() OVER () AS piece FROM w)
), q AS (
  SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4
  FROM o WINDOW x AS (PARTITION BY piece ORDER BY i)
), f AS MATERIALIZED (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS a FROM q GROUP BY lang, w1
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM q WHERE w2 IS NOT NULL GROUP BY lang, phrase
    HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM q WHERE w3 IS NOT NULL
    GROUP BY lang, phrase HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM q WHERE w4 IS NOT NULL
    GROUP BY lang, phrase HAVING count(*) >= 30
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS parts FROM f WHERE size > 1
), u AS (
  SELECT lang, list_aggregate(parts[i:i + m - 1], 'string_agg', ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, parts, a, m, unnest(range(1, size - m + 2)) AS i FROM c, range(2, 4) AS t(m) WHERE m < size)
  GROUP BY 1, 2
), k AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r,
    CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT c.*, unnest(range(1, size)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = list_aggregate(c.parts[1:k], 'string_agg', ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = list_aggregate(c.parts[k + 1:], 'string_agg', ' ')
  WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.lang = c.lang AND u.phrase = c.phrase AND 100 * u.a >= 80 * c.a)
), b AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), z AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""


@R.query("op13_collocations", COLLOCATION_SQL)
def phrases(spark, folder):
    return collocations.collocations(documents(spark, folder))


@R.query("op12_factor_quality")
def good(spark, folder):
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select(
        "doc_id", held_out_row(parts=3, held_out=1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
