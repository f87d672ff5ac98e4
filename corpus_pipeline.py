"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages carry the whole row as one column, so that further columns of any name pass through. Null texts count as empty:
quality rules reject them, as they do all texts under 50 words. An empty table gives an empty one at every stage. Ties
and repeated rows: see the stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from strandline.llm.common import WHITE, drop, noted, row_key, save, unwrapped, whole, work_dir


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words from which a repeated passage counts though it stands in one or two lines.
LONG_WORDS = 50


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the rules' posterior rejects go. Repeated rows are judged alike, and stay or go together."""
    judged = quality_rules.judge(docs.select(whole(docs), "text"), ["row"])
    return judged.filter("kept").select(*unwrapped(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later repeated runs of lines go, and documents of which no word is left.

    Runs of three lines or more, and of one or two lines with 50 words or more. Of equal runs the one of smallest
    doc_id stays (nulls last); rows equal in doc_id and text are one text here, and stay together.
    """
    out = line_dedup.remove_lines(docs.select(whole(docs, "doc_id", "text"), "doc_id", "text"), long_words=LONG_WORDS)
    out = out.filter((F.col("n_removed") == 0) | (F.btrim(F.col("text"), F.lit(WHITE)) != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*unwrapped(docs, doc_id=F.col("doc_id"), text=F.col("text"), n_chars=length))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): of each group of linked documents the one of smallest doc_id stays.

    Nulls are last; equal doc_ids tie by a hash of doc_id and text, rows equal in both by their other columns as JSON, so
    that a rerun keeps the same row.
    """
    folder = work_dir(spark)
    keyed = docs.select(whole(docs, "doc_id", "text"), "doc_id", "text", row_key("doc_id", "text").alias("key"))
    ids = save(keyed.select("doc_id", "key"), folder, "ids")
    with noted() as folders:
        groups = jaccard_join.similar_texts(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("of")).distinct()
        best = ids.join(groups, "key").groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
        stay = save(best.select("best.key"), folder, "stay")
    drop(spark, f"{folder}/ids", *folders)
    rows = keyed.join(stay.hint("merge"), "key", "left_semi")
    first = F.min_by(F.struct("text", "row"), F.to_json("row", {"ignoreNullFields": "false"}))
    rows = rows.groupBy("key", "doc_id").agg(first.alias("first")).select("doc_id", "first.*")
    return rows.select(*unwrapped(docs, doc_id=F.col("doc_id"), text=F.col("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each source's documents as often as its quota of blocks takes them; equal rows are numbered and share the words taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of each text and the text decoded from them, a row for each row."""
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Expectation-maximisation and byte-pair encoding have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; the last stage's rows.

    What a stage has stored goes as soon as its result is written, and the result when the next one's is.
    """
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark), []
    for k, (name, stage) in enumerate(STAGES):
        with noted() as folders:
            docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, folder, f"{k}_{name}")
            drop(spark, *folders, *before)
            before = [f"{folder}/{k}_{name}"]
    return docs
