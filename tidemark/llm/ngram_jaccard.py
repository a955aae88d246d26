"""Operator 1: exact n-gram Jaccard join by vertical partitioning.

Every document becomes a set of word n-grams. One global order of all n-grams
(rare before frequent, from counts over every document) is cut into fragments,
and each set into one segment per fragment. Pairs that can reach the threshold
meet on an n-gram of their rarest part; the overlaps of their segments are then
counted per fragment, independently, and summed per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import merged
from tidemark.llm.words import chained, mixed, slices
from tidemark.llm.workspace import attach_groups, semi, small_batches, staged

SKETCH_BITS = 22
CELLS = 8192
#: Fragments of the order: so many less one for n-grams that don't stand out, the last for frequent ones.
FRAGMENTS = 4
#: N-grams in more documents than this have their posting list dealt over SALTS tasks.
SALT_FROM = 20_000
SALTS = 64
#: Closest candidates of a set that are verified first; the others follow unless by then in one class.
FIRST = 3
#: Postings in a block, on average.
BLOCK = 2048
#: Bits per n-gram of the parities that are compared before a pair is verified.
FINE = 4
#: Sets that a task remembers so as not to describe a copy twice; beyond that it forgets them and repeats do no harm.
SEEN = 50_000


def ngram_sets(column: pa.Array, width: int):
    """For each row of the column in turn: row number, sorted distinct 64-bit n-gram hashes."""
    for text in slices(column):
        start, end, row = text.words()
        h = text.hashes(start, end, fold=True)
        if len(h) >= width:
            grams = chained(h, width)
            of = row[: len(grams)]
            whole = of == row[width - 1 :]
            grams, of = grams[whole], of[whole]
        else:
            grams, of = h[:0], row[:0]
        cut = np.searchsorted(of, np.arange(text.n + 1))
        words = np.searchsorted(row, np.arange(text.n + 1))
        for i in range(text.n):
            mine = grams[cut[i] : cut[i + 1]]
            n = words[i + 1] - words[i]
            if 0 < n < width:
                mine = mixed(chained(h[words[i] : words[i + 1]], int(n)) ^ np.uint64(n))
            yield text.first + i, np.unique(mine)


def _name(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _short(name: bytes) -> int:
    """What stands for a name in postings; sets that share it are told apart when pairs are made of postings."""
    return int.from_bytes(name[:8], "little", signed=True)


def _parities(grams: np.ndarray) -> np.ndarray:
    """About FINE bits per n-gram, each the parity of those that fall on it; a power of two of 64-bit words."""
    words = 1 << max(0, (max(len(grams), 1) * FINE - 1).bit_length() - 6)
    words = min(words, 256 * FINE)
    bit = (grams >> np.uint64(20)) & np.uint64(words * 64 - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_md5", T.BinaryType()),
        T.StructField("name", T.BinaryType()),
        T.StructField("short", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("parity", T.ArrayType(T.LongType())),
        T.StructField("cell", T.IntegerType()),
        T.StructField("counts", T.BinaryType()),
    ]
)


class _Sketch:
    """Counters of hash ranges, two bytes each, that stop at their highest value."""

    def __init__(self):
        self.counts = np.zeros(1 << SKETCH_BITS, np.uint16)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
        self.size += len(grams)
        if self.size > 1 << 18:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            at, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.counts[at] = np.minimum(self.counts[at] + n, 65535)
            self.waiting, self.size = [], 0


def _describe(width: int):
    def run(batches):
        seen: set[bytes] = set()
        sketch = _Sketch()
        for batch in batches:
            name, n, parity = [], [], []
            for _, grams in ngram_sets(batch.column(1), width):
                mine = _name(grams) if len(grams) else None
                if mine is not None and mine not in seen:
                    seen = set() if len(seen) >= SEEN else seen
                    seen.add(mine)
                    sketch.add(grams)
                name.append(mine)
                n.append(len(grams))
                parity.append(_parities(grams) if len(grams) else None)
            short = [None if x is None else _short(x) for x in name]
            none = pa.nulls(len(name))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(name, pa.binary()), pa.array(short, pa.int64()), pa.array(n, pa.int64()), pa.array(parity, pa.list_(pa.int64()))]
                + [none.cast(pa.int32()), none.cast(pa.binary())],
                names=SETS.names,
            )
        sketch.flush()
        parts = sketch.counts.reshape(-1, CELLS)
        used = np.flatnonzero(parts.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 64)):
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays(
                [none.cast(kind) for kind in SET_TYPES] + [pa.array(some, pa.int32()), pa.array([_packed(parts[i]) for i in some], pa.binary())],
                names=SETS.names,
            )

    return run


SET_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def _packed(counts: np.ndarray) -> bytes:
    """Counters as they are, or, where few aren't 0, their places and values."""
    at = np.flatnonzero(counts)
    if 2 * len(at) >= len(counts):
        return counts.tobytes()
    return at.astype(np.uint16).tobytes() + counts[at].tobytes()


def _added(batches):
    """Sums the counters of each cell; one array per cell of this task is held."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            mine = np.frombuffer(counts.as_buffer(), np.uint16)
            into = total.setdefault(cell, np.zeros(CELLS, np.int32))
            if len(mine) == CELLS:
                into += mine
            else:
                at, n = mine.reshape(2, -1)
                into[at] += n
    for cell, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["cell", "counts"])


#: Counters above this are as good as each other for finding the usual one.
TALL = 4096


def _tallied(batches):
    tally = np.zeros(TALL + 1, np.int64)
    for batch in batches:
        for counts in batch.column(1):
            tally += np.bincount(np.minimum(np.frombuffer(counts.as_buffer(), np.int32), TALL), minlength=TALL + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TALL + 1, dtype=np.int32)), pa.array(tally)], names=["n", "ranges"])


def _levels(bar: float):
    def run(batches):
        for batch in batches:
            out = []
            for counts in batch.column(1):
                n = np.frombuffer(counts.as_buffer(), np.int32)
                out.append(np.where(n > bar, 1 + 2 * np.log2(np.maximum(n, 1) / bar), 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["cell", "level"])

    return run


def gram_levels(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Frequency level of each of 2**SKETCH_BITS hash ranges, and the level from which n-grams are salted.

    Counts cover all documents; the table has a fixed size, a byte per range.
    Level 0 are ranges that hold no n-gram which stands out, level k those that
    hold one about 2**(k/2) times more frequent. Any levels give right results:
    they only decide which n-grams come late in the order.
    """
    cells = sets.filter("cell is not null").select("cell", "counts").repartition("cell")
    cells = staged(cells.mapInArrow(_added, "cell int, counts binary"), "counts")
    tally = np.zeros(TALL + 1, np.int64)
    for row in cells.mapInArrow(_tallied, "n int, ranges long").groupBy("n").agg(F.sum("ranges").alias("ranges")).collect():
        tally[row.n] = row.ranges
    tally[0] = 0
    usual = float(np.searchsorted(np.cumsum(tally), tally.sum() / 2)) if tally.any() else 1.0
    bar = usual + 4 * usual**0.5 + 1
    level = np.zeros((1 << SKETCH_BITS) // CELLS * CELLS, np.uint8).reshape(-1, CELLS)
    for row in cells.mapInArrow(_levels(bar), "cell int, level binary").toLocalIterator():
        level[row.cell] = np.frombuffer(row.level, np.uint8)
    return level.ravel(), int(1 + 2 * np.log2(max(SALT_FROM / bar, 1)))


def _in_order(grams: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams in the global order (by level, then hash), and their levels."""
    mine = level[grams >> np.uint64(64 - SKETCH_BITS)]
    if not mine.any():
        return grams, mine
    order = np.argsort(mine, kind="stable")
    return grams[order], mine[order]


def _prefixes(width: int, per: int, levels, salted_from: int):
    """Postings of each set's rarest part: the first n - ceil(per/100 * n) + 1 n-grams in the global order."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            gram, short, packed = [], [], []
            for _, grams in ngram_sets(batch.column(0), width):
                n = len(grams)
                if n == 0 or (mine := _short(_name(grams))) in seen:
                    continue
                seen = set() if len(seen) >= SEEN else seen
                seen.add(mine)
                p = n - -(-per * n // 100) + 1
                ordered, level = _in_order(grams, levels.value)
                gram.append(ordered[:p])
                short.append(np.full(p, mine, np.int64))
                packed.append((np.int64(n) << 32) | (np.arange(p) << 1) | (level[:p] >= salted_from))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gram).view(np.int64)), pa.array(np.concatenate(short)), pa.array(np.concatenate(packed))], names=["gram", "short", "packed"])

    return run


def _segments(width: int, levels):
    """Each set cut into its segments, one per fragment of the order."""
    step = (1 << 64) // (FRAGMENTS - 1)
    cuts = np.array([k * step for k in range(1, FRAGMENTS - 1)], np.uint64)

    def run(batches):
        for batch in batches:
            name, segments = [], []
            for _, grams in ngram_sets(batch.column(0), width):
                ordered, level = _in_order(grams, levels.value)
                usual = int(np.searchsorted(level, 1))
                name.append(_name(grams))
                segments.append([x.view(np.int64) for x in (*np.split(ordered[:usual], np.searchsorted(ordered[:usual], cuts)), ordered[usual:])])
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(segments, pa.list_(pa.list_(pa.int64())))], names=["name", "segments"])

    return run


def _sizes_fit(a: str, b: str, per: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * per


def _reachable(per: int) -> Column:
    """Whether two sets that meet first at these positions can still reach the threshold."""
    most = 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)
    return most * (100 + per) >= per * (F.col("na") + F.col("nb"))


def _different(a: Column, b: Column) -> Column:
    """Bits that differ between two parity tables, the larger folded onto the smaller."""
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.zip_with(F.slice(x, 1, F.size(x) / 2), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)), xor)
    a2 = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a)
    b2 = F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(a2, b2, lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, x: s + x)


class _Lists:
    """Some blocks of posting lists, each in order of size of set: which of their pairs are in different classes and may reach the threshold."""

    COLUMNS = ("own", "node", "n", "i", "comp")
    SMALL = 48
    WORDS = 1 << 21

    def __init__(self, batch: pa.RecordBatch, per: int):
        self.per = per
        self.own, self.node, self.n, self.i, self.comp = (batch.column(c).to_numpy() for c in self.COLUMNS)
        lo, hi, gram = (batch.column(c).to_numpy() for c in ("lo", "hi", "gram"))
        self.within = lo == hi
        parity = batch.column("parity")
        self.at, self.values = parity.offsets.to_numpy(), parity.values.to_numpy().view(np.uint64)
        self.words = np.diff(self.at)
        new = np.flatnonzero((gram[1:] != gram[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        self.starts = np.concatenate([[0], new]).astype(np.int64) if len(gram) else np.zeros(0, np.int64)

    def pairs(self, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places x, y of such pairs and the parities in which they differ; with `forest` only so many that they connect what all connect."""
        sizes = np.diff(np.append(self.starts, len(self.n)))
        parts = []
        for size in np.unique(sizes[sizes <= self.SMALL]):
            x, y = np.triu_indices(size, 1)
            first = self.starts[sizes == size][:, None]
            parts.append(self._near((first + x).ravel(), (first + y).ravel()))
        for start, size in zip(self.starts[sizes > self.SMALL], sizes[sizes > self.SMALL], strict=True):
            rows = [self._near(np.full(start + size - x - 1, x), np.arange(x + 1, start + size)) for x in range(start, start + size - 1)]
            parts.append(self._thinned(tuple(np.concatenate(c) for c in zip(*rows, strict=True)), forest))
        return self._thinned(tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3, forest)

    def _thinned(self, found, forest: bool):
        pick = _forest(*found, self.comp) if forest and len(found[0]) else slice(None)
        return tuple(c[pick] for c in found)

    def _near(self, x: np.ndarray, y: np.ndarray):
        total = self.n[x] + self.n[y]
        most = 1 + np.minimum(self.n[x] - self.i[x] - 1, self.n[y] - self.i[y] - 1)
        keep = (self.comp[x] != self.comp[y]) & (self.n[x] * 100 >= self.n[y] * self.per) & (most * (100 + self.per) >= self.per * total)
        keep &= self.within[x] | (self.own[x] != self.own[y])
        x, y, total = x[keep], y[keep], total[keep]
        off = np.zeros(len(x), np.int64)
        # parities never get shorter with size: the longer are folded onto the shorter
        shape = self.words[x] * 65536 + self.words[y]
        for kind in np.unique(shape):
            short, long = divmod(int(kind), 65536)
            of = np.flatnonzero(shape == kind)
            for some in np.array_split(of, -(-len(of) * long // self.WORDS)):
                a = self.values[self.at[x[some]][:, None] + np.arange(short)]
                b = self.values[self.at[y[some]][:, None] + np.arange(long)].reshape(len(some), -1, short)
                off[some] = np.bitwise_count(a ^ np.bitwise_xor.reduce(b, axis=1)).sum(axis=1)
        near = (total - off) * (100 + self.per) >= 2 * self.per * total
        return x[near], y[near], off[near]


def _forest(x: np.ndarray, y: np.ndarray, off: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Places of pairs that connect all that the pairs connect: in turn the nearest pair of each class as joined so far."""
    _, of = np.unique(comp, return_inverse=True)
    left, picked = np.arange(len(x)), []
    while len(left):
        side = np.concatenate([of[x[left]], of[y[left]]])
        order = np.lexsort((np.tile(left, 2), np.tile(off[left], 2), side))
        some = np.unique(left[order[np.unique(side[order], return_index=True)[1]] % len(left)])
        picked.append(some)
        while len(some):
            # one of two joined classes takes the other's label, until all pairs picked are inside one
            np.minimum.at(low := np.arange(of.max() + 1), np.maximum(of[x[some]], of[y[some]]), np.minimum(of[x[some]], of[y[some]]))
            of = low[of]
            some = some[of[x[some]] != of[y[some]]]
        left = left[of[x[left]] != of[y[left]]]
    return np.concatenate(picked) if picked else left


def _compared(per: int, forest: bool):
    """Pairs of blocks that may link, from rows in order of block and size; with `forest` few pairs that connect the same classes."""

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            lists = _Lists(rows, per)
            # the last block may go on in the next batch
            last = int(lists.starts[-1]) if len(lists.starts) else 0
            held = rows.slice(last)
            if last:
                yield _found(rows.slice(0, last), per, forest)
        if held is not None:
            yield _found(held, per, forest)

    return run


def _found(rows: pa.RecordBatch, per: int, forest: bool) -> pa.RecordBatch:
    # a slice keeps what lies before it: copied, places count from its own start
    lists = _Lists(pa.concat_batches([rows, rows.slice(0, 0)]), per)
    x, y, off = lists.pairs(forest)
    a, b = lists.node[x], lists.node[y]
    columns = [np.minimum(a, b), np.maximum(a, b), lists.n[x] + lists.n[y], off]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PAIR)


PAIR = ["a", "b", "total", "off"]


class NgramJaccardJoin:
    """Links texts whose n-gram sets have 100 * intersection >= per * union.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A
    text with fewer than `width` words is one n-gram, its whole sequence; one
    without words is empty and linked with nothing. Null texts are empty. Rows
    that repeat a text, with the same or another doc_id, share its class. A
    null doc_id is carried along; a class of only such rows has a null id. An
    empty table gives empty results; other columns are ignored.

    Sets are known by a 128-bit hash, their n-grams by 64-bit ones.

    Every pair that can link shares an n-gram of both rarest parts. Postings are
    first paired with one partner per list, so that large groups of near copies
    are joined by as many pairs as they have postings. Lists that still hold
    several classes are then compared in blocks of bounded size inside tasks,
    where sizes, positions and parities (all true bounds) rule pairs out: once
    for a few pairs that join what can be joined, once for all others that no
    bound rules out and whose sets are still apart.
    """

    def __init__(self, docs: DataFrame, width: int = 5, per: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        small_batches(docs.sparkSession)
        self.width, self.per, self.block = width, per, block
        spark = docs.sparkSession
        marked = self.docs.withColumn("text_md5", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
        sets = staged(marked.mapInArrow(_describe(width), SETS), "sets")
        self.sets = sets.filter("cell is null").select("doc_id", "text_md5", "name", "short", "n", "parity")
        level, self._salted_from = gram_levels(sets)
        self._levels = spark.sparkContext.broadcast(level)
        known = self.sets.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")).alias("first"), F.count("*").alias("copies"), F.first("short").alias("short"), F.first("n").alias("n"), F.first("parity").alias("parity"))
        # numbers are read back from the written table, so they stay the same
        self.nodes = staged(known.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self._links: DataFrame | None = None
        self._tried: DataFrame | None = None
        self._classes: DataFrame | None = None
        self._segmented: DataFrame | None = None

    def _postings(self) -> DataFrame:
        """Postings that share their n-gram with another set, each with one set to be compared with first.

        The first partner differs from n-gram to n-gram, so a large group of
        near copies is linked through many of its members, by as many pairs as
        it has postings and not by all its pairs.
        """
        rows = self.docs.select("text").mapInArrow(_prefixes(self.width, self.per, self._levels, self._salted_from), "gram long, short long, packed long")
        rows = rows.select(
            "gram",
            "short",
            F.shiftright("packed", 32).alias("n"),
            F.shiftright(F.col("packed").bitwiseAND(0xFFFFFFFF), 1).alias("i"),
            F.when(F.col("packed").bitwiseAND(1) == 1, F.pmod(F.col("short"), F.lit(SALTS))).otherwise(-1).alias("salt"),
        )
        near = Window.partitionBy("gram", "salt").orderBy(F.xxhash64("short", "gram"), "short")
        rows = rows.withColumns({"hub": F.first("short").over(near), "hub_n": F.first("n").over(near), "hub_i": F.first("i").over(near), "_next": F.lead("short").over(near), "_last": F.lag("short").over(near)})
        # copies of a set described in several tasks lie side by side, one of them counts
        rows = rows.filter(~F.col("_last").eqNullSafe(F.col("short")))
        # the last row of a group has no next one: a group of one is both its hub and its last
        alone = (F.col("salt") == -1) & (F.col("_next").isNull() | (F.col("_next") == F.col("short"))) & (F.col("hub") == F.col("short"))
        return staged(rows.filter(~alone | F.col("_next").isNotNull()).drop("_next", "_last"), "postings")

    def _first_pairs(self, live: DataFrame) -> DataFrame:
        a = [F.col("short").alias("sa"), F.col("n").alias("na"), F.col("i").alias("ia")]
        meet = live.select(*a, F.col("hub").alias("sb"), F.col("hub_n").alias("nb"), F.col("hub_i").alias("ib"))
        top = Window.partitionBy("gram").orderBy(F.xxhash64("short", "gram"), "short")
        hubs = live.filter("salt >= 0 and short = hub").select("gram", "short", "n", "i")
        hubs = hubs.select(*a, F.first("short").over(top).alias("sb"), F.first("n").over(top).alias("nb"), F.first("i").over(top).alias("ib"))
        return self._pairs(meet.unionByName(hubs))

    def _pairs(self, meet: DataFrame) -> DataFrame:
        """Distinct pairs of sets that meet, without those that sizes, positions or parities rule out."""
        meet = meet.filter("sa <> sb").filter(_sizes_fit("na", "nb", self.per)).filter(_reachable(self.per))
        pairs = meet.select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb")).distinct()
        side = lambda k: self.nodes.select(F.col("short").alias(f"s{k}"), F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
        pairs = pairs.join(side("a"), "sa").join(side("b"), "sb").withColumn("total", F.col("na") + F.col("nb")).withColumn("off", _different(F.col("pa"), F.col("pb")))
        # |A xor B| = |A| + |B| - 2 * overlap, and no fewer n-grams differ than parities do
        near = (F.col("total") - F.col("off")) * (100 + self.per) >= 2 * self.per * F.col("total")
        return pairs.filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", "off")

    def _best(self, pairs: DataFrame) -> DataFrame:
        """The FIRST closest partners of each set, by parities."""
        sides = pairs.select(F.col("a").alias("x"), "*").unionByName(pairs.select(F.col("b").alias("x"), "*"))
        closest = Window.partitionBy("x").orderBy("off", "a", "b")
        return sides.withColumn("_k", F.row_number().over(closest)).filter(F.col("_k") <= FIRST).select(*PAIR).distinct()

    def _open(self, live: DataFrame) -> DataFrame:
        """Postings of n-grams that sets of several classes share, with each set's node and class, if they can be the first that a linked pair shares.

        Unless its list is salted, a first partner has met all others of the list before and is left out.
        """
        at = live.filter("salt >= 0 or short <> hub").select("gram", "short", "n", "i").join(self.nodes.select("short", "node"), "short")
        at = at.join(self._classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = at.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.count("*").alias("postings"))
        at = at.join(several.filter("lo <> hi").drop("lo", "hi"), "gram")
        partner = F.greatest(F.ceil(F.col("n") * self.per / 100), "least")
        return staged(at.filter((F.col("n") - F.col("i")) * (100 + self.per) >= self.per * (F.col("n") + partner)), "open")

    def _block_pairs(self, at: DataFrame, forest: bool) -> DataFrame:
        """Pairs of different classes that share a rare n-gram and may link, found inside blocks of its posting list."""
        at = at.join(self.nodes.select("node", "parity"), "node")
        blocks = F.ceil(F.col("postings") / self.block).cast("int")
        at = at.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        at = at.select("gram", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own", "node", "n", "i", "comp", "parity")
        # comparing takes longer than its few bytes tell: not to be dealt to fewer tasks
        at = at.repartition(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi", "n")
        found = at.mapInArrow(_compared(self.per, forest), "a long, b long, total long, off long")
        return found.groupBy("a", "b").agg(F.min("total").alias("total"), F.min("off").alias("off"))

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs not yet tried whose sets aren't in one class."""
        comp = self._classes
        out = pairs if self._tried is None else pairs.join(self._tried, ["a", "b"], "left_anti")
        out = out.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
        return out.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*PAIR)

    def _segments_for(self, pairs: DataFrame) -> DataFrame:
        """Segments of all sets that pairs need: node, fragment, segment; a text is read when a pair first needs it."""
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self._segmented is not None:
            need = need.join(self._segmented.filter("fragment = 0").select("node"), "node", "left_anti")
        # a set's text is read from one of its rows
        need = staged(self.nodes.join(need, "node", "left_semi").select("node", "name", "doc_id"), "need")
        if not need.isEmpty():
            texts = semi(self.docs, need.filter("doc_id is not null").select("doc_id"), "doc_id").select("text")
            if not need.filter("doc_id is null").isEmpty():
                texts = texts.unionByName(self.docs.filter("doc_id is null").select("text"))
            rows = texts.mapInArrow(_segments(self.width, self._levels), "name binary, segments array<array<long>>")
            rows = rows.join(need.select("name", "node"), "name").groupBy("node").agg(F.first("segments").alias("segments"))
            fresh = staged(rows.select("node", F.posexplode("segments").alias("fragment", "segment")), "segments", "lz4")
            self._segmented = fresh if self._segmented is None else self._segmented.unionByName(fresh)
        return self._segmented

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose overlaps, counted fragment by fragment and summed, reach the threshold."""
        segments = self._segments_for(pairs)
        mine = pairs.join(segments.withColumnRenamed("node", "a").withColumnRenamed("segment", "sa"), "a")
        both = mine.join(segments.withColumnRenamed("node", "b").withColumnRenamed("segment", "sb"), ["b", "fragment"])
        part = both.select("a", "b", "total", F.size(F.array_intersect("sa", "sb")).alias("overlap"))
        total = part.groupBy("a", "b", "total").agg(F.sum("overlap").alias("overlap"))
        return total.filter(F.col("overlap") * (100 + self.per) >= self.per * F.col("total")).select("a", "b", "overlap")

    def _join(self, pairs: DataFrame) -> None:
        """Verifies pairs, the closest ones first and others only if their sets are still apart."""
        for pick in (self._best, lambda rest: rest):
            some = staged(pick(self._apart(pairs)), "pairs")
            if some.isEmpty():
                break
            found = staged(self._verified(some), "links")
            self._tried = some.select("a", "b") if self._tried is None else self._tried.unionByName(some.select("a", "b"))
            if not found.isEmpty():
                self._links = found if self._links is None else self._links.unionByName(found)
                self._classes = merged(self._classes, found)

    def connecting_links(self) -> DataFrame:
        """(a, b, overlap) between sets: enough links to connect every class, all of them verified; other true links inside a class are left out."""
        if self._links is not None:
            return self._links
        live = self._postings()
        spark = self.docs.sparkSession
        self._classes = spark.createDataFrame([], "node long, comp long")
        self._join(staged(self._first_pairs(live), "candidates"))
        for forest in (True, False):
            at = self._open(live)
            if at.isEmpty():
                break
            self._join(staged(self._block_pairs(at, forest), "candidates"))
        return spark.createDataFrame([], "a long, b long, overlap long") if self._links is None else self._links

    def classes(self) -> DataFrame:
        """One row per row of the input: doc_id, n_shingles, component_id, n_connecting_links, text_md5, first.

        n_connecting_links counts those of its set that connecting_links returns,
        not all its links. first marks the row that stands for its class, the one
        with the smallest doc_id (null last), of such the smallest digest; rows
        that repeat it are marked, too, and so is every row without words.
        """
        links = self.connecting_links()
        degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("n_connecting_links"))
        nodes = self.nodes.select("node", "name", "doc_id", "first", "copies").join(self._classes, "node", "left").join(degree, "node", "left")
        nodes = nodes.withColumn("comp", F.coalesce("comp", "node"))
        low = nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("low_first"))
        nodes = staged(nodes.select("name", "comp", "copies", F.coalesce("n_connecting_links", F.lit(0)).alias("n_connecting_links")).join(low, "comp").drop("comp"), "classes")
        sets = self.sets.select("doc_id", "text_md5", "name", "n")
        rows = attach_groups(sets, nodes, "name", "copies", sets.count())
        return rows.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_connecting_links", F.lit(0)).cast("long").alias("n_connecting_links"),
            "text_md5",
            ((F.col("n") == 0) | F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5").eqNullSafe(F.col("low_first"))).alias("first"),
        )


def near_duplicate_classes(docs: DataFrame, width: int = 5, per: int = 80) -> DataFrame:
    return NgramJaccardJoin(docs, width, per).classes()
