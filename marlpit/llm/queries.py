"""The operators' queries: each runs its operator over the whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import bytebpe, divergence, langid, licenses, lines, media, mixing, negatives, packing, quality, simhash, tokens, urls
from marlpit.llm.common import cut, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; a null text has none, repeated rows count each, other columns are not read."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, in training order; equal rows share what falls to them."""
    ordered = mixing.training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return ordered.select("row.doc_id", "source", "size", "source_size", "target", "taken", "position")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; pages without a usable url are allowed, repeated pages get equal verdicts."""
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; null or wordless texts are ``und``, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_words")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; a null text has no words and fails, repeated rows are judged each."""
    stats = cut(quality.rule_stats(table(spark, sf_dir, "documents")))
    model = quality.fit(quality.labelled_stats(stats, table(spark, sf_dir, "labels")))
    return quality.judge(stats, model).drop("features")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier one; the first by id (null last) and line stays, rows that repeat are one document."""
    found = lines.dropped_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have fingerprint zero and link like others."""
    found = simhash.components_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches in every whole text; a null text has no words."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text's tokens; a null text is its end id alone, repeated rows are packed each."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of every whole text, read back; equal texts give equal values, a null text counts as empty."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and their over-used terms; null columns count as ''."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


# Same terms, groups and sums, without a sketch: every term is counted, every pair of sources meets at every kept term.
_DIVERGENCE_SQL = """WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 w AS (SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY 1, 2 HAVING count(DISTINCT n) >= 30),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT g.lang, g.source, k.term, k.lc, coalesce(x.c, 0) AS c FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL) x USING (lang, source, term)),
 p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
  1 + (1000000000 * (lc + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM c),
 v AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM v QUALIFY part = 'pair' OR rank <= 50"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors' positives; a part of the labels is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 50 == 0)


# Every anchor against every row, in exact whole numbers.
_NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY rank <= 3"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the bytes that they decode to, as digests; a null text is empty, repeated rows count each."""
    coded = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), column="text")
    return bytebpe.digests(coded, "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op11_divergence": _DIVERGENCE_SQL, "op12_hard_negatives": _NEGATIVES_SQL}
