"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, filter_audit, jaccard_join, langid, line_dedup, mixing, packing, phrases, quality_model, quality_rules, substring_dedup, token_files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_texts(_docs(spark, sf_dir), words=3, num=90, den=100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_OP2_SQL = r"""
WITH lines AS (
    SELECT doc_id, pos - 1 AS pos, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), worded AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
    SELECT doc_id, k, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3 FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
    SELECT doc_id, k FROM (
        SELECT doc_id, k, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, k) AS n FROM windows WHERE line3 IS NOT NULL) WHERE n > 1
), dead AS (
    SELECT DISTINCT w.doc_id, w.pos FROM worded w JOIN later l ON w.doc_id = l.doc_id AND w.k BETWEEN l.k AND l.k + 2
), kept AS (
    SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.pos) AS text FROM lines ANTI JOIN dead ON lines.doc_id = dead.doc_id AND lines.pos = dead.pos GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed,
    length(coalesce(kept.text, ''))::BIGINT AS kept_chars, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM worded GROUP BY 1) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM dead GROUP BY 1) g ON g.doc_id = d.doc_id
LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_docs(spark, sf_dir), digest=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 9).alias("quality"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_OP11_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), fails AS (
    SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM texts
), masks AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM fails LEFT JOIN (SELECT doc_id AS of, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) ON of = doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY 1, 2
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), permutations AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM permutations, range(1, 6) s(step)
), done AS (
    SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM done
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir))


_OP12_SQL = r"""
WITH tokens AS (
    SELECT doc_id, lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (
        SELECT doc_id, lang, generate_subscripts(p, 1) AS piece, list_filter(string_split_regex(unnest(p), '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
            SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents))
), ahead AS (
    SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4, lead(word, 4) OVER p AS w5
    FROM tokens WINDOW p AS (PARTITION BY doc_id, piece ORDER BY k)
), counts AS (
    SELECT lang, w, count(*) AS a FROM (
        SELECT lang, unnest([[w1], [w1, w2], [w1, w2, w3], [w1, w2, w3, w4], [w1, w2, w3, w4, w5]][1:1 + (w2 IS NOT NULL)::INT + (w3 IS NOT NULL)::INT + (w4 IS NOT NULL)::INT + (w5 IS NOT NULL)::INT]) AS w FROM ahead)
    GROUP BY 1, 2
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE len(w) = 1 GROUP BY 1
), often AS (
    SELECT * FROM counts WHERE a >= 100
), inside AS (
    SELECT s.lang, s.w FROM often s JOIN often b ON s.lang = b.lang AND s.a <= b.a AND len(b.w) = len(s.w) + 1 AND (b.w[1:len(s.w)] = s.w OR b.w[2:] = s.w)
), cuts AS (
    SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM often ANTI JOIN inside USING (lang, w) WHERE len(w) > 1
), scores AS (
    SELECT c.lang, array_to_string(c.w, ' ') AS phrase, c.a, x.a AS l, y.a AS r, n, k, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
    FROM cuts c JOIN totals t ON t.lang = c.lang JOIN often x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN often y ON y.lang = c.lang AND y.w = c.w[k + 1:]
), best AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP1_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, word, k FROM (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents))
), threes AS (
    SELECT doc_id, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS s FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY k)
), shingles AS (
    SELECT DISTINCT doc_id, s FROM threes WHERE s IS NOT NULL
    UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY k) FROM words GROUP BY doc_id HAVING count(*) < 3
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 90 * (x.n + y.n - pairs.n)
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_OP7_SQL = r"""
WITH words AS (
    SELECT doc_id, word, k FROM (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents))
), windows AS (
    SELECT doc_id, k, string_agg(word, ' ') OVER w AS t, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), repeated AS (
    SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY t) AS times FROM windows WHERE n = 35) WHERE times > 1
), dead AS (
    SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM repeated
), kept AS (
    SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS t FROM words ANTI JOIN dead ON words.doc_id = dead.doc_id AND words.k = dead.k GROUP BY 1
)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) a ON a.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM dead GROUP BY 1) b ON b.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": _OP11_SQL, "op12_phrases": _OP12_SQL, "op1_jaccard_join": _OP1_SQL, "op2_line_dedup": _OP2_SQL, "op7_substring_dedup": _OP7_SQL}
