"""A training corpus from `documents`: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. What a stage returns is written and read again
as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup, normalised
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_jaccard import near_duplicate_classes
from tidemark.llm.quality_rules import fit_rules, judged
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.sentencepieces import SentencePieces
from tidemark.llm.workspace import staged


def _decided(docs: DataFrame, digest: Column, decision: DataFrame) -> DataFrame:
    """Rows of docs that a decision names by doc_id (null equals null) and digest of the text; of rows that repeat both, one.

    decision has doc_id, digest and rows, the number of rows that it names. Rows
    travel inside a struct, so no column of theirs can clash.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("text_digest"))
    d = decision.alias("d")
    found = rows.join(d, (F.col("text_digest") == F.col("d.digest")) & F.col("id").eqNullSafe(F.col("d.doc_id")))
    once = found.filter("d.rows = 1").select("row.*")
    again = found.filter("d.rows > 1").dropDuplicates(["id", "text_digest"]).select("row.*")
    return once.unionByName(again)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or a learned one; labels come from the labels table.

    Null and empty texts fail the base rule. Each row is judged by its own text,
    repeated rows alike, and goes on as it came, whatever its columns are
    called. An empty table stays empty.
    """
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return judged(rows, rules).filter("_kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one row stays: that with the smallest doc_id, one without id only if none has any."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    decision = staged(kept.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), "kept")
    return _decided(docs, F.unhex(F.sha2(normalised("text"), 256)), decision)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest doc_id stays, one without id only if none has any; texts without words all stay."""
    kept = near_duplicate_classes(docs).filter("first").select("doc_id", F.col("text_md5").alias("digest"))
    decision = staged(kept.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), "kept")
    return _decided(docs, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))), decision)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: each document as often as the mix reads it, each copy at the time when its reading begins.

    Rows are in that order within partitions, and partitions follow each other:
    written files in order of name hold the stream. Texts that are null, empty
    or without words are of size 0 and not taken. Rows that repeat both doc_id
    and text are taken as often as any of them; ties in time go by a hash of
    both. An empty table gives no rows.
    """
    rows = mix(docs).filter("copies > 0")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce(F.col("text"), F.lit("")))
    # rows that repeat another have its key; each is taken as often as any of them
    repeated = rows.groupBy("doc_id", "key").agg(F.max(F.struct("copies", "times"))["times"].alias("times"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("own"))
    out = whole.join(repeated.alias("r"), (F.col("own") == F.col("r.key")) & F.col("id").eqNullSafe(F.col("r.doc_id")))
    out = out.select("row", "own", F.explode("r.times").alias("time"))
    return out.repartitionByRange("time", "own").sortWithinPartitions("time", "own").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang with number and digest of each whole text's ids, and the digest of the text decoded from them.

    A row for each row of docs, repeated ones too; null texts are empty, and
    empty ones have no ids. An empty table gives no rows.
    """
    digest = SentencePieces(docs, tokenizer_file("piece_bpe_32k.model")).digest(F.col("text"))
    return docs.select("doc_id", "source", "lang", digest.alias("_d")).select("doc_id", "source", "lang", "_d.*")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing", mixed),
    ("SentencePiece encoding", encode),
]

#: Rules are learned and pieces are encoded: SQL can't say that. tests/llm holds each stage against a plain version on awkward rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
