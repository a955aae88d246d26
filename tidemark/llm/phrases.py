"""Operator 12: phrase collocations by Rabin-Karp fingerprints.

A prefix polynomial over the hashes of a text's words, mod 2^64, gives every run
of words its fingerprint as one difference times an inverse power, so numpy
hashes all n-grams of a batch at once. Counting goes by length: words first, then
pairs of frequent words, then longer runs all of whose pairs are frequent, since
no phrase is more frequent than a part of it. Shuffles of these rounds carry a
fingerprint and a count. Which fingerprints are frequent goes to the tasks as a
bit table of bounded size; a wrong hit costs work and changes nothing. The last
round reads the texts of what is frequent: in each batch a fingerprint points to
its first occurrence, all others are compared with that byte by byte, and only
then the phrase is made a string and counted under its text, with a pointer to
the first occurrence of all. So counts are exact whatever collides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.words import SPACE, Text, mixed, slices
from tidemark.llm.workspace import small_batches, staged

#: Bytes that end a piece, and those that part words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = SPACE | ENDS

BASE = 0x9E3779B97F4A7C15
#: Bits of the largest table of frequent fingerprints (16 MB), and bits a fingerprint.
GATE_BITS = 27
PER_FINGERPRINT = 16
#: Bytes of text that are hashed at once.
SLICE = 4 << 20


class Gate:
    """Which fingerprints are frequent; some others pass, too."""

    def __init__(self, bits: int, table: np.ndarray):
        self.shift, self.table = np.uint64(64 - bits), table

    def hit(self, fp: np.ndarray) -> np.ndarray:
        at = fp >> self.shift
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def gate(frequent: DataFrame) -> Gate:
    """The bit table of a column fp; the driver gets at most 2^(GATE_BITS - 6) words of it, whatever the number of rows."""
    bits = min(GATE_BITS, max(16, (PER_FINGERPRINT * frequent.count()).bit_length()))
    at = F.shiftrightunsigned("fp", 64 - bits)
    words = frequent.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return Gate(bits, table)


class Grams:
    """Fingerprints of all runs of words inside pieces of some rows."""

    def __init__(self, text: Text, salt: np.ndarray):
        self.text = text
        self.start, self.end, self.row = text.words(APART)
        n = len(self.start)
        if not n:
            return
        piece = np.cumsum(ENDS[text.bytes])[self.start]
        self.run = np.cumsum(np.r_[False, (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])])
        words = mixed(text.hashes(self.start, self.end, fold=True) ^ salt[self.row])
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, BASE, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
            self.sums = np.r_[np.uint64(0), np.cumsum(words * power)]

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of all runs of `size` words."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.run[:n] == self.run[size - 1 :])
        with np.errstate(over="ignore"):
            fp = (self.sums[first + size] - self.sums[first]) * self.inverse[first]
        return first, mixed(fp + np.uint64(size))

    def gated(self, size: int, part: int, frequent: Gate) -> tuple[np.ndarray, np.ndarray]:
        """Those of which all parts of `part` words pass the gate."""
        passes = np.zeros(len(self.start), bool)
        first, fp = self.of(part)
        passes[first[frequent.hit(fp)]] = True
        first, fp = self.of(size)
        keep = np.ones(len(first), bool)
        for k in range(size - part + 1):
            keep &= passes[first + k]
        return first[keep], fp[keep]


def _salts(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Number of each row's lang in the list of langs; their hashes salt the words."""
    coded = langs.fill_null("und").dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


def _slices(batch: pa.RecordBatch):
    at, langs = _salts(batch.column(0))
    salt = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)[at]
    for text in slices(batch.column(1), SLICE):
        rows = slice(text.first, text.first + text.n)
        yield Grams(text, salt[rows]), at[rows], langs


def _counted(sizes, part, frequent):
    def run(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for grams, _, _ in _slices(batch):
                found += [grams.gated(size, part, frequent.value)[1] for size in sizes]
            fp, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n)], names=["fp", "n"])

    return run


def _unlike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a on are others than those from b on; data has 8 bytes to spare."""
    lanes = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out, todo, k = np.zeros(len(a), bool), np.arange(len(a)), 0
    while len(todo):
        out[todo] |= ((lanes[a[todo] + k] ^ lanes[b[todo] + k]) & mask[np.minimum(size[todo] - k, 8)]) != 0
        k += 8
        todo = todo[(size[todo] > k) & ~out[todo]]
    return out


def _texts(sizes, frequent):
    """lang, phrase, count in the slice and pointer (doc_id, number of the word) to the first occurrence there, of runs whose fingerprint passes."""

    def run(batches):
        for batch in batches:
            for grams, at, langs in _slices(batch):
                found = [(size, *grams.of(size)) for size in sizes] if len(grams.start) else []
                hits = [(size, first[h], fp[h]) for size, first, fp in found for h in [frequent.value.hit(fp) if frequent else slice(None)]]
                if not sum(len(x[1]) for x in hits):
                    continue
                first = np.concatenate([x[1] for x in hits])
                last = np.concatenate([x[1] + x[0] - 1 for x in hits])
                _, shown, same, n = np.unique(np.concatenate([x[2] for x in hits]), return_index=True, return_inverse=True, return_counts=True)
                data, place = grams.text.spaced(APART)
                data = np.r_[data, np.zeros(8, np.uint8)]
                begin = place[grams.start[first]]
                size = place[grams.end[last] - 1] + 1 - begin
                row = grams.row[first]
                model = shown[same]
                other = (size != size[model]) | (at[row] != at[row[model]])
                other[~other] = _unlike(data, begin[~other], begin[model[~other]], size[~other])
                # what collides with another text is a row of its own
                np.subtract.at(n, same[other], 1)
                pick, count = np.r_[shown, np.flatnonzero(other)], np.r_[n, np.ones(other.sum(), np.int64)]
                opening = np.searchsorted(grams.row, row[pick])
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[x] for x in at[row[pick]].tolist()], pa.string()),
                        pa.array([raw[i : i + k] for i, k in zip(begin[pick].tolist(), size[pick].tolist(), strict=True)], pa.binary()).cast(pa.string()),
                        pa.array(count),
                        batch.column(2).take(pa.array(row[pick] + grams.text.first)),
                        pa.array(first[pick] - opening),
                    ],
                    names=["lang", "phrase", "n", "doc_id", "word"],
                )

    return run


def _frequent_texts(docs: DataFrame, sizes, frequent, least: int) -> DataFrame:
    rows = docs.mapInArrow(_texts(sizes, frequent), "lang string, phrase string, n long, doc_id long, word long")
    pointer = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "word")
    out = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min(pointer).alias("at"))
    return out.filter(F.col("n") >= least).select("lang", "phrase", "n", "at.doc_id", "at.word")


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 to `longest` words with exact counts and a pointer (doc_id, word) to an occurrence; and all words by lang."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    words = staged(_frequent_texts(rows, (1,), None, 1), "words")
    totals = staged(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = words.filter(F.col("n") >= least)
    found = words.select("lang", F.col("phrase").alias("text")).mapInArrow(_fingerprints, "fp long")
    shared = spark.sparkContext.broadcast(gate(found))
    tables = []
    for sizes, part in (((2,), 1), (tuple(range(3, longest + 1)), 2)):
        if sizes and longest >= sizes[0]:
            counts = rows.mapInArrow(_counted(sizes, part, shared), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
            tables.append(staged(counts.filter(F.col("n") >= least).select("fp"), "frequent"))
            shared = spark.sparkContext.broadcast(gate(tables[-1]))
    if not tables:
        return words, totals
    every = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    shared = spark.sparkContext.broadcast(gate(every))
    longer = _frequent_texts(rows, tuple(range(2, longest + 1)), shared, least)
    return staged(words.unionByName(longer), "phrases"), totals


def _fingerprints(batches):
    """Fingerprints of single words of a lang."""
    for batch in batches:
        found = [grams.of(1)[1] for grams, _, _ in _slices(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["fp"])


def _product(*factors: Column) -> Column:
    """Of whole numbers below 10^18, as a decimal of 38 digits."""
    out = factors[0].cast("decimal(38,0)")
    for f in factors[1:]:
        out = (out * f.cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The `top` phrases of each lang by score: lang, rank, phrase, a, l, r, n, score, and a pointer first_doc_id, first_word.

    A phrase has 2 to `longest` words inside a piece and a >= `least`
    occurrences; its score is that of its worst cut, in whole numbers. Phrases
    inside a longer one that has `share` percent of their count are dropped.
    Ties go by count and then by the phrase's bytes. first_word counts the words
    of the document that the pointer names from 0, the first by doc_id, null last.
    Null texts are empty, a null lang is `und`, repeated rows count each, an
    empty table gives no rows; other columns are ignored.
    """
    found, totals = phrase_counts(docs, least, longest, text_col, lang_col, id_col)
    parts = found.select("lang", "phrase", "n")
    made = F.split("phrase", " ")
    long_ = found.withColumn("words", made).filter(F.size("words") > 1)
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = long_.select("lang", "phrase", "words", F.col("n").alias("a"), k)
    joined = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("words")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    score = _product(F.lit(1000), F.col("a"), F.col("total")), _product(F.col("l"), F.col("r"))
    cuts = cuts.withColumns({"over": score[0], "under": score[1]}).withColumn("score", F.expr("over div under"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("v")).select("lang", "phrase", "v.*")
    # (words, first word and length) of every part of a longer phrase
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    inside = long_.filter(size > 2).select("lang", F.explode(spans).alias("phrase"), F.col("n").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    where = long_.select("lang", "phrase", F.col("doc_id").alias("first_doc_id"), F.col("word").alias("first_word"))
    out = ranked.join(where, ["lang", "phrase"])
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "first_doc_id", "first_word")
