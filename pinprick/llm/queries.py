"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, jaccard, katz, orc_tokens, packing, phrases, runs, sharding, simhash, substring, toxicity, warc

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_read(spark, sf_dir, "documents"), keep="largest")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), "words", 2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), "bytes", 0, 1024)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.looped(_read(spark, sf_dir, "documents")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length, r.start, r.period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    longest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return longest.select("doc_id", "n_runs", F.col("b.start"), (-F.col("b.col1")).alias("length"), F.col("b.period"), F.expr("(-b.col1 * 1000) div b.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_toxicity, op4_orc_tokens, op5_decontamination, op6_katz, op7_sharding, op8_packing, op9_simhash, op10_substring, op11_runs, op12_collocations, op13_jaccard)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
             q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM q""",
    "op12_collocations": """
        WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
             word AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
             total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM word GROUP BY lang),
             size AS (SELECT unnest([1, 2, 3, 4, 5]) AS words),
             spot AS (SELECT lang, words, w, unnest(range(1, len(w) - words + 2)) AS i FROM word, size WHERE len(w) >= words),
             f AS (SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, count(*) AS f FROM spot GROUP BY ALL HAVING count(*) >= 100),
             c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
             inner_part AS (SELECT DISTINCT c.lang, c.f, array_to_string(c.w[i:i + size.words - 1], ' ') AS phrase FROM c, size, range(1, 6) t(i) WHERE size.words BETWEEN 2 AND c.words - 1 AND i + size.words - 1 <= c.words),
             kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_part p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.f >= 100 * c.f)),
             cut AS (SELECT kept.lang, phrase, f AS a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM kept, range(1, 5) t(k) WHERE k < words),
             scored AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
                        FROM cut JOIN total ON total.lang = cut.lang JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
             weak AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER g AS rank, phrase, a, l, r, n, score FROM weak
        WINDOW g AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000""",
}
