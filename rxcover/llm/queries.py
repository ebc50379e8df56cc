"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcover.llm import (
    bpe,
    collocations,
    decontaminate,
    exact_dedup,
    language,
    mixing,
    ngram_join,
    quality,
    search,
    secret_scan,
    token_files,
    toxicity,
    vector_dedup,
)
from rxcover.llm.shared import new_folder, remainder, table


def op1_projection_passes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.linked_vectors(table(spark, folder, "embeddings"), threshold=0.95)


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents"), size=3, numerator=9, denominator=10)


def op3_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, quality.grades(table(spark, folder, "labels")))
    return quality.graded(docs, model)


def op4_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scanned(table(spark, folder, "documents"))


def op5_factorization_machine(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("target"))
    model = toxicity.train(docs, labels.filter(remainder("doc_id", 4) != 2))
    return toxicity.scored(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op6_word_shuffle_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs, ranks = table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.encoded(docs, bpe.tiktoken_encoder(ranks, public_tokenizers.PATTERN))
    return bpe.decoded(tokens, ranks).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    filters = language.learn(docs.filter(remainder("doc_id", 3) != 1))
    return language.identified(docs, filters).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op8_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mixed(docs)


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    digest = F.sha2(exact_dedup.normalised("text"), 256)
    return exact_dedup.exact_groups(docs.withColumn("text_sha256", digest), carry=["text_sha256"])


def op10_elias_fano_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = public_tokenizers.path("byte_bpe_50k.json")
    prepare, added = bpe.tokenizers_encoder(model, special=True), bpe.added_tokens(model)
    files = new_folder(spark, "tokens")
    tokens = partial(bpe.encoded, docs, prepare, end=2, added=added)
    token_files.write_tokens(tokens, docs.select("doc_id"), files, bytes_per_id=2)
    return token_files.read_tokens(spark, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_rabin_karp_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_prefix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_projection_passes": op1_projection_passes,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_secret_forest": op4_secret_forest,
    "op5_factorization_machine": op5_factorization_machine,
    "op6_word_shuffle_bpe": op6_word_shuffle_bpe,
    "op7_language_filters": op7_language_filters,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_elias_fano_files": op10_elias_fano_files,
    "op11_rabin_karp_collocations": op11_rabin_karp_collocations,
    "op12_norm_buckets": op12_norm_buckets,
    "op13_prefix_decontamination": op13_prefix_decontamination,
}

EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id
  FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""

MIXING_SQL = """
WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (
  SELECT source, n, CAST(floor(1000 * sqrt(n) + 0.5) AS HUGEINT) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i
  FROM counted),
lists AS (
  SELECT list(w ORDER BY i) AS w, list((n + 7) // 8 ORDER BY i) AS b, CAST(sum(w) AS HUGEINT) AS total, count(*) AS k,
         CAST(sum((n + 7) // 8) AS BIGINT) AS blocks
  FROM weighted),
plan AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS i, CAST(0 AS BIGINT) AS placed,
         [CAST(0 AS BIGINT) FOR x IN range(k)] AS done FROM lists
  UNION ALL
  SELECT slot, i, placed + CASE WHEN i IS NULL THEN 0 ELSE 1 END,
         list_transform(done, lambda d, j: d + CASE WHEN j = i THEN 1 ELSE 0 END)
  FROM (
    SELECT plan.slot + 1 AS slot, plan.done AS done, placed,
           list_min([(CAST(((done[j] + 1) * total + w[j] - 1) // w[j] AS BIGINT), j) FOR j IN range(1, k + 1)
                     IF done[j] < b[j] AND done[j] * total // w[j] <= plan.slot + 1])[2] AS i
    FROM plan, lists WHERE placed < blocks)),
placed AS (
  SELECT slot, weighted.i, source, n, w, done[weighted.i] - 1 AS block,
         sum(least(8, n - 8 * (done[weighted.i] - 1))) OVER (ORDER BY slot) - least(8, n - 8 * (done[weighted.i] - 1)) AS ahead
  FROM plan JOIN weighted ON weighted.i = plan.i),
numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS r
  FROM documents)
SELECT doc_id, d.source, CAST(block AS BIGINT) AS mix_block, slot AS mix_slot,
       CAST(block * total // placed.w AS BIGINT) AS mix_release,
       CAST(((block + 1) * total + placed.w - 1) // placed.w AS BIGINT) AS mix_deadline,
       CAST(ahead + r % 8 AS BIGINT) AS mix_position
FROM numbered d JOIN placed ON d.source IS NOT DISTINCT FROM placed.source AND r // 8 = block, lists
"""

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(p[1:c], ' ') AS first, array_to_string(p[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, c,
         CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(p[s:s + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS s FROM candidates WHERE k = 3))
  GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT b, item_id, t, count(*) AS times
  FROM (SELECT row_number() OVER () AS b, item_id, unnest(
          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM benchmark)
  GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
scale AS (SELECT i, doc_id, 75 + (25 * len(w) * n) // l AS m FROM d, total WHERE len(w) > 0),
tf AS (SELECT i, t, count(*) AS tf FROM (SELECT i, unnest(w) AS t FROM d) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, n),
scored AS (
  SELECT b, item_id, doc_id, i, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN weight USING (t) JOIN scale USING (i) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""

DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT i, k, s, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM (SELECT i, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lengths WHERE len(w) >= k)),
found AS (SELECT i, s, d.k, item_id FROM doc_windows d JOIN item_windows p ON d.t = p.t AND d.k = p.k),
hit AS (SELECT i, count(DISTINCT p) AS n_hit FROM (SELECT i, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT i, s, k FROM found)) GROUP BY i),
named AS (
  SELECT i, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT i, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (i) LEFT JOIN named USING (i)
"""

ORACLES: dict[str, str] = {
    "op8_pfair_mixing": MIXING_SQL,
    "op9_exact_dedup": EXACT_DEDUP_SQL,
    "op11_rabin_karp_collocations": COLLOCATIONS_SQL,
    "op12_norm_buckets": SEARCH_SQL,
    "op13_prefix_decontamination": DECONTAMINATION_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
