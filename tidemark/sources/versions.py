"""Tables whose data never changes in place: folders of Parquet, and a manifest per version that names those in use.

Whoever writes first writes its rows to a folder that no manifest names, and then
the manifest of the next version, which one rename puts in place. Readers see
the version they began with; a write that dies leaves a folder that nobody
reads; of two writers that began from one version the second fails. The rename
is atomic on HDFS and local file systems; object stores need one that is.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Entry(NamedTuple):
    """kind `part`: the part (chunk or bucket) is in that load; `delta`: rows of a batch; `seen`: the last batch of a stream."""

    kind: str
    part: str
    load: str
    batch: int


_ENTRY = "kind string, part string, load string, batch long"


class VersionConflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


class Versions:
    """The manifests of a table at path. A manifest is read on the driver: a line per chunk or bucket and per batch since the last compaction."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """Number of the last version; 0 if there is none."""
        if not self._files().exists(self._path("log")):
            return 0
        names = [s.getPath().getName() for s in self._files().listStatus(self._path("log"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def entries(self, version: int) -> list[Entry]:
        if version == 0:
            return []
        return [Entry(*r) for r in self.spark.read.schema(_ENTRY).parquet(f"{self.path}/log/{version:09d}").collect()]

    def commit(self, after: int, entries: list[Entry]) -> int:
        """Makes entries the version that follows `after`; VersionConflict if there is one."""
        staged, name = f"log/_{uuid.uuid4().hex}", f"log/{after + 1:09d}"
        self.spark.createDataFrame([tuple(e) for e in entries], _ENTRY).coalesce(1).write.parquet(f"{self.path}/{staged}")
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._files().makeQualified(self._path(staged)), self._files().makeQualified(self._path(name)), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"{self.path} has a version {after + 1}") from e
            raise
        return after + 1

    def loads(self) -> set[str]:
        """Folders of data that are there, in use or not."""
        if not self._files().exists(self._path("data")):
            return set()
        return {s.getPath().getName().removeprefix("load=") for s in self._files().listStatus(self._path("data"))}

    def cleaned(self, keep: int = 2) -> int:
        """Deletes data that none of the last `keep` versions names, and older manifests; for when nobody reads those or writes. Folders deleted."""
        last = self.latest()
        kept = {e.load for v in range(max(1, last - keep + 1), last + 1) for e in self.entries(v)}
        gone = self.loads() - kept
        for load in gone:
            self._files().delete(self._path(f"data/load={load}"), True)
        for s in self._files().listStatus(self._path("log")) if last else []:
            name = s.getPath().getName()
            if not name.isdigit() or int(name) <= last - keep:
                self._files().delete(s.getPath(), True)
        return len(gone)

    def read_loads(self, schema: T.StructType, loads: set[str]) -> DataFrame:
        """Rows of some loads, and in which each is."""
        whole = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
        if not loads:
            return self.spark.createDataFrame([], whole)
        folders = [f"{self.path}/data/load={x}" for x in sorted(loads)]
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders)

    def read_parts(self, schema: T.StructType, column: str, entries: list[Entry]) -> DataFrame:
        """Rows of the parts that entries name; `column` (in schema) is the folder of a part, so others are not opened."""
        parts = {(e.load, e.part) for e in entries if e.kind == "part"}
        rows = self.read_loads(schema, {load for load, _ in parts})
        return rows.filter(F.concat_ws("/", "load", F.col(column).cast("string")).isin([f"{x}/{p}" for x, p in sorted(parts)])).select(*schema.names)


def _load() -> str:
    return uuid.uuid4().hex


def write_chunks(df: DataFrame, path: str, fetched: list[str] | None = None) -> int:
    """Replaces the chunks (`_chunk`) that df has, all in one step, and leaves the others where they are; the version.

    Chunks in `fetched` without rows in df are gone afterwards.
    """
    table, load = Versions(df.sparkSession, path), _load()
    before = table.latest()
    df.write.partitionBy("_chunk").parquet(f"{path}/data/load={load}")
    written = {f.name: f.dataType for f in df.schema}
    rows = table.read_loads(T.StructType([T.StructField("_chunk", written["_chunk"])]), {load})
    new = [r[0] for r in rows.select(F.col("_chunk").cast("string")).distinct().collect()]
    kept = [e for e in table.entries(before) if e.part not in {*new, *(fetched or [])}]
    return table.commit(before, kept + [Entry("part", c, load, 0) for c in new])


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """Rows of the current version, or of an earlier one; schema names `_chunk`, too."""
    table = Versions(spark, path)
    return table.read_parts(schema, "_chunk", table.entries(table.latest() if version is None else version))


def publish(df: DataFrame, path: str) -> int:
    """Df in place of all that was at path, in one step; df may read from path. The version."""
    table, load = Versions(df.sparkSession, path), _load()
    before = table.latest()
    df.write.parquet(f"{path}/data/load={load}")
    return table.commit(before, [Entry("part", "", load, 0)])


def current(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """What has been published last, or as an earlier version; empty if nothing has."""
    table = Versions(spark, path)
    loads = {e.load for e in table.entries(table.latest() if version is None else version)}
    return table.read_loads(schema, loads).select(*schema.names)


class RowLog(Versions):
    """Rows of batches, each batch once."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        super().__init__(spark, path)
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def append(self, batch: DataFrame, number: int, stream: str = "") -> bool:
        """Adds the rows of a stream's batch as they are, and the batch to the ledger, in one commit; False if it is there already."""
        before = self.latest()
        entries = self.entries(before)
        if any(e.kind == "seen" and e.part == stream and e.batch >= number for e in entries):
            return False
        load = _load()
        batch.select(*self.schema.names).write.parquet(f"{self.path}/data/load={load}")
        kept = [e for e in entries if not (e.kind == "seen" and e.part == stream)]
        self.commit(before, [*kept, Entry("delta", "", load, number), Entry("seen", stream, "", number)])
        return True

    def deltas(self, entries: list[Entry]) -> DataFrame:
        """Rows of batches that are not merged yet, with the number of their batch."""
        some = [e for e in entries if e.kind == "delta"]
        rows = self.read_loads(self.schema, {e.load for e in some})
        if not some:
            return rows.select(*self.schema.names, F.lit(0).cast("long").alias("_batch"))
        number = F.create_map(*[F.lit(x) for e in some for x in (e.load, e.batch)])
        return rows.select(*self.schema.names, number[F.col("load")].alias("_batch"))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows up to a version."""
        return self.deltas(self.entries(self.latest() if version is None else version)).drop("_batch")


class KeyedTable(RowLog):
    """One row per key in `buckets` files, each sorted by key (F2), and rows of later batches beside them until they are merged.

    `order` says which of two rows with one key stays: the later by these
    columns, nulls first; name enough of them to tell rows apart. With by_batch
    that of the later batch stays, whatever its columns. Keys can't be null. Rows of a
    key are always in the same bucket, so an upsert reads and writes the buckets
    only that it has keys of, and stored rows are joined where they are.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 64, by_batch: bool = False):
        super().__init__(spark, path, schema)
        self.keys, self.order, self.by_batch = keys, order, by_batch
        # a join keeps stored rows in place only if their buckets are as many tasks as a shuffle would make, or more
        self.buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _bucket(self, buckets: int) -> Column:
        """The number that Spark gives a row's bucket."""
        return F.pmod(F.hash(*self.keys), F.lit(buckets))

    def _base_buckets(self, entries: list[Entry]) -> int:
        """Buckets of the table as it is, or of one about to be made."""
        return next((e.batch for e in entries if e.kind == "part"), self.buckets)

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per key: the last by batch (column _batch, if the table goes by it) and order."""
        by = F.struct(*(["_batch"] if self.by_batch else []), *self.order)
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), by).alias("_v")).select("_v.*")

    def _stored(self, entries: list[Entry], buckets: int) -> str:
        """Name of a table over the given buckets, for Spark to know how they lie; it is the caller's to drop."""
        name = f"stored_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        by = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {name} ({columns}, load STRING, _bucket INT) USING parquet OPTIONS (path '{self.path}/data') PARTITIONED BY (load, _bucket) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS")
        if entries:
            self.spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (load='{e.load}', _bucket={e.part})" for e in entries))
        return name

    def _merged(self, stored: DataFrame, fresh: DataFrame) -> DataFrame:
        """Rows of stored with those of fresh in their place, or beside them."""
        s, f = stored.alias("s"), fresh.withColumn("_in", F.lit(True)).hint("merge").alias("f")
        both = s.join(f, [F.col(f"s.{k}") == F.col(f"f.{k}") for k in self.keys], "full_outer")
        later = F.col("f._in").isNotNull()
        if not self.by_batch:
            rank = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in self.order])
            later &= F.col(f"s.{self.keys[0]}").isNull() | (rank("f") >= rank("s"))
        return both.select(*[F.when(later, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in self.schema.names])

    def merge_plan(self, fresh: DataFrame, entries: list[Entry]) -> tuple[DataFrame, list[str], str]:
        """Rows of all buckets that fresh has keys of, after the upsert; those buckets; the name of the table over them, for the caller to drop."""
        entries = [e for e in entries if e.kind == "part"]
        buckets = self._base_buckets(entries)
        some_null = F.exists(F.array(*[F.col(k).isNull() for k in self.keys]), lambda x: x)
        touched = {str(r.b) for r in fresh.select(F.when(some_null, -1).otherwise(self._bucket(buckets)).alias("b")).distinct().collect()}
        if "-1" in touched:
            raise ValueError(f"keys of {self.path} can't be null")
        name = self._stored([e for e in entries if e.part in touched], buckets)
        stored = self.spark.table(name).drop("load", "_bucket")
        return self._merged(stored, self.newest(fresh)), sorted(touched), name

    def upsert(self, fresh: DataFrame) -> int:
        """Merges fresh into the buckets that it has keys of, after batches that wait; the other files stay. The version."""
        before = self.compact()
        return self._rewritten(before, fresh.withColumn("_batch", F.lit(0)), self.entries(before))

    def _rewritten(self, before: int, fresh: DataFrame, entries: list[Entry]) -> int:
        """Commits entries with fresh merged into their buckets."""
        buckets, load = self._base_buckets(entries), _load()
        out, touched, name = self.merge_plan(fresh, entries)
        try:
            out.withColumns({"load": F.lit(load), "_bucket": self._bucket(buckets)}).write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")
        kept = [e for e in entries if e.kind != "part" or e.part not in touched]
        return self.commit(before, kept + [Entry("part", b, load, buckets) for b in touched])

    def base(self, entries: list[Entry]) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        return self.read_parts(whole, "_bucket", entries).drop("_bucket")

    def read(self, version: int | None = None) -> DataFrame:
        """One row per key, in buckets and deltas together."""
        entries = self.entries(self.latest() if version is None else version)
        base = self.base(entries)
        if not any(e.kind == "delta" for e in entries):
            return base
        return self.newest(base.withColumn("_batch", F.lit(-1).cast("long")).unionByName(self.deltas(entries)))

    def compact(self) -> int:
        """Merges the batches that lie beside the buckets into those that they have keys of; the ledger stays."""
        before = self.latest()
        entries = self.entries(before)
        if not any(e.kind == "delta" for e in entries):
            return before
        return self._rewritten(before, self.deltas(entries), [e for e in entries if e.kind != "delta"])


class HistoryLog(KeyedTable):
    """Every revision of a key is kept; a batch is appended as it is, and read in order of `order`.

    A revision that repeats the state (`check`) before it is no change when it is
    read, but it stays: one that comes later may lie between the two. The log is
    never rewritten by a batch; `compact` moves revisions into the buckets of their keys.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], check: list[str], order: list[str], buckets: int = 64):
        super().__init__(spark, path, schema, keys, order, buckets)
        self.check = check

    def _changes(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(*self.order)
        state = F.struct(*self.check)
        before = F.lag(state).over(w)
        return rows.withColumn("_new", before.isNull() | ~before.eqNullSafe(state)).filter("_new").drop("_new")

    def _revisions(self, entries: list[Entry]) -> DataFrame:
        return self._changes(self.base(entries).unionByName(self.deltas(entries).drop("_batch")))

    def read(self, version: int | None = None) -> DataFrame:
        """Revisions with valid_from (their first order column) and valid_to (that of the next; null while it holds)."""
        entries = self.entries(self.latest() if version is None else version)
        w = Window.partitionBy(*self.keys).orderBy(*self.order)
        return self._revisions(entries).select(*self.keys, *self.check, F.col(self.order[0]).alias("valid_from"), F.lead(self.order[0]).over(w).alias("valid_to"))

    def state(self) -> DataFrame:
        """The last revision of each key, without a window over its history."""
        entries = self.entries(self.latest())
        return self.newest(self.base(entries).unionByName(self.deltas(entries).drop("_batch")))

    def compact(self) -> int:
        before = self.latest()
        entries = self.entries(before)
        fresh = self.deltas(entries).drop("_batch")
        if not any(e.kind == "delta" for e in entries):
            return before
        buckets, load = self._base_buckets(entries), _load()
        touched = {str(r.b) for r in fresh.select(self._bucket(buckets).alias("b")).distinct().collect()}
        stored = self.base([e for e in entries if e.part in touched])
        rows = stored.unionByName(fresh).withColumn("_bucket", self._bucket(buckets))
        rows.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", *self.keys, *self.order).write.partitionBy("_bucket").parquet(f"{self.path}/data/load={load}")
        kept = [e for e in entries if e.kind == "seen" or (e.kind == "part" and e.part not in touched)]
        return self.commit(before, kept + [Entry("part", b, load, buckets) for b in sorted(touched)])
