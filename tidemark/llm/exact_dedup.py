"""Operator 2: exact deduplication against a persistent digest index, DataFrame functions only.

The index is a table bucketed and sorted by the digest of the normalised text.
New rows are reduced to one row per digest before the shuffle, sort-merge
anti-joined to the index (whose buckets are read in place) and appended under
the name of their load, so a load that is run again decides as it did before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import attach_groups, staged

#: Digests that a bucket of a new index is meant to hold.
PER_BUCKET = 4_000_000


def normalised(text: str):
    """Text with each run of space and 0x09-0x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class DigestIndex:
    """digest (binary SHA-256), keep_id, group_size, keep_rows, load; one row per distinct text seen so far.

    load names the load that first brought a text, keep_id is the smallest
    doc_id of the text in that load, group_size the number of its rows there and
    keep_rows how many of these carry keep_id (over 1 where a row is repeated).
    Null doc_ids come after all others; a text that has no other keeps a null
    keep_id. A table is made by the first load, with at least `buckets` buckets
    (as many as the session's shuffle partitions, if missing) and more where
    that load or `expected` digests ask for it. Every load adds a file to each
    bucket; `compact` makes them one again and is for whoever keeps the index.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, expected: int = 0):
        self.spark, self.expected = spark, expected
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = table or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and digest of every row; the text is read once and goes no further."""
        digest = F.unhex(F.sha2(normalised(text_col), 256)).alias("digest")
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest)

    def append(self, digests: DataFrame, load: str) -> DataFrame | None:
        """Adds the digests that the index lacks under the name of the load; one that is run again lacks none and adds none.

        Returns digest and group_size of those that it had; None if it was empty.
        """
        per_id = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
        fresh = per_id.groupBy("digest").agg(
            F.min("doc_id").alias("keep_id"),
            F.sum("rows").alias("group_size"),
            F.coalesce(F.min_by("rows", "doc_id"), F.sum("rows")).alias("keep_rows"),
        )
        known = None
        if self.exists():
            fresh = staged(fresh, "load")
            have = self.read().select("digest")
            # what is said of the table must not change when it is appended to
            known = staged(fresh.join(have.hint("merge"), "digest", "left_semi").select("digest", "group_size"), "known")
            fresh = fresh.join(have.hint("merge"), "digest", "left_anti")
        self._write(staged(fresh.withColumn("load", F.lit(load)), "digests"), self.table)
        return known

    def _write(self, rows: DataFrame, table: str) -> None:
        buckets = self._buckets(rows)
        rows.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(table)

    def _buckets(self, rows: DataFrame) -> int:
        """Buckets of the table, or of one about to be made."""
        if not self.exists():
            return max(self.buckets, -(-max(self.expected, rows.count()) // PER_BUCKET))
        described = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
        return int(described["Num Buckets"])

    def compact(self) -> None:
        """Writes the index anew with one sorted file a bucket; until the last step the old table is whole."""
        other = f"{self.table}_next"
        self.spark.sql(f"DROP TABLE IF EXISTS {other}")
        self._write(self.read(), other)
        self.spark.sql(f"ALTER TABLE {self.table} RENAME TO {self.table}_old")
        self.spark.sql(f"ALTER TABLE {other} RENAME TO {self.table}")
        self.spark.sql(f"DROP TABLE {self.table}_old")

    def classify(self, digests: DataFrame, load: str | None) -> DataFrame:
        """Every row with its text's group; a row is kept if it is the first of its group and its load brought the text (load None: whichever did)."""
        total = digests.count()
        here = digests.groupBy("digest").agg(F.count("*").alias("_here"))
        groups = here.join(self.read().hint("merge"), "digest")
        rows = attach_groups(digests, groups, "digest", "_here", total)
        own = F.lit(True) if load is None else F.col("load") == load
        return rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            (own & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "keep_rows",
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, load: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marks every row of docs: doc_id, keep_id, group_size, kept, text_sha256, keep_rows.

    Of texts equal after normalisation the row with the smallest doc_id is kept.
    Null and empty texts are one group. Rows that repeat both doc_id and text
    are all marked kept, and keep_rows says how many there are. An empty table
    gives an empty result; other columns are ignored.

    With an index that an earlier load has filled, texts it brought are not
    kept; keep_id and group_size are then those of that load. `load` names this
    one (at random if missing): run again under its name, it gives the same
    rows. Without an index one is made for this table, loaded with it, and
    dropped when the result has been written.
    """
    own, load = DigestIndex(docs.sparkSession) if index is None else None, load or uuid.uuid4().hex
    index = index or own
    digests = staged(index.digests(docs, id_col, text_col), "digests")
    if own is None:
        index.append(digests, load)
        return index.classify(digests, load)
    try:
        index.append(digests, load)
        return staged(index.classify(digests, load), "deduplicated")
    finally:
        index.drop()


def dedup_in_loads(docs: DataFrame, loads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """exact_dedup of one table that comes in several loads, in order of doc_id, into one index, with groups of the whole table.

    A load is anti-joined to what earlier ones left in the index; what is new is
    appended with its keep_id, and what is known is counted under the load's
    name. As loads come in order of doc_id, the load that brought a text has its
    smallest one, so keep_id is read from the index, and group_size is the sum
    of its counts; no group is made of all rows again. Ranges are cut by
    approximate quantiles of doc_id, null ids come with the last; a cut decides
    on the size of loads only. The index is dropped when the result has been written.
    """
    index = DigestIndex(docs.sparkSession)
    digests = staged(index.digests(docs, id_col, text_col), "digests")
    cuts = digests.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / loads) for k in range(1, loads)]), F.lit(1000))).first()[0] if loads > 1 else []
    part = F.lit(loads - 1)
    for k in reversed(range(len(cuts or []))):
        part = F.when(F.col("doc_id") <= cuts[k], k).otherwise(part)
    try:
        seen = None
        for k in range(loads):
            again = index.append(digests.filter(part == k), f"load-{k}")
            seen = again if seen is None else seen.unionByName(again) if again is not None else seen
        kept = index.read().hint("merge")
        if seen is not None:
            more = seen.groupBy("digest").agg(F.sum("group_size").alias("_more"))
            kept = kept.join(more.hint("merge"), "digest", "left").withColumn("group_size", F.col("group_size") + F.coalesce("_more", F.lit(0)))
        rows = attach_groups(digests, kept.select("digest", "keep_id", "group_size", "keep_rows"), "digest", "group_size", digests.count())
        mine = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
        return staged(rows.select("doc_id", "keep_id", "group_size", mine, F.lower(F.hex("digest")).alias("text_sha256"), "keep_rows"), "deduplicated")
    finally:
        index.drop()
