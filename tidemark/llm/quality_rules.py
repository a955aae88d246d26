"""Operator 10: quality rules as a learned decision list.

Statistics of every text are counted in Arrow batches. From a bounded sample of
labelled rows, sequential covering grows threshold conjunctions for the class
"reject" and prunes each on rows set aside; the list becomes one ordered Spark
conditional expression, evaluated in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import chained, slices
from tidemark.llm.workspace import small_batches

#: Labelled rows from which rules are learned, at most; those with the smallest hash.
SAMPLE = 20_000
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_distinct long, n_marks long"
FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeats", "uppers", "digits", "distinct", "marks", "words_a_line")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLASS = {"upper": range(65, 91), "digit": range(48, 58), "mark": [ord(c) for c in "!?"]}


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_TABLES = {k: _table(v) for k, v in _CLASS.items()}


def _per_row(at: np.ndarray, positions: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(np.searchsorted(at[1:], positions, side="right"), minlength=n)[:n]


def text_stats(column: pa.Array) -> list[np.ndarray]:
    """The columns of STATS for each row of the column."""
    parts = []
    for text in slices(column):
        b, at, n = text.bytes, text.at, text.n
        start, end, row = text.words()
        words = np.bincount(row, minlength=n)
        first_byte = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        chars = np.bincount(row, weights=(first_byte[end] - first_byte[start]), minlength=n).astype(np.int64)
        h = text.hashes(start, end, fold=False)
        repeat = np.zeros(n, np.int64)
        if len(h) >= 3:
            first = np.flatnonzero(row[:-2] == row[2:])
            key = chained(h, 3)[first] ^ (row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            twice = first[counts[inverse] > 1]
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[twice + k] = True
            repeat = np.bincount(row[covered], minlength=n)
        own = h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, one = np.unique(own, return_index=True)
        distinct = np.bincount(row[one], minlength=n)
        # lines: between newlines, and never across rows
        newline = np.flatnonzero(b == 10)
        line_start = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], newline + 1]))
        line_start = line_start[line_start < len(b)]
        dup = np.zeros(n, np.int64)
        lines = np.zeros(n, np.int64)
        if len(line_start) and len(start):
            line_end = np.append(line_start[1:], len(b))
            line_end -= (b[line_end - 1] == 10) & (line_end > line_start)
            of = np.searchsorted(at[1:], line_start, side="right")
            full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
            line_start, line_end, of = line_start[full], line_end[full], of[full]
            lh = text.hashes(line_start, line_end, fold=False) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, one = np.unique(lh, return_index=True)
            lines = np.bincount(of, minlength=n)
            dup = lines - np.bincount(of[one], minlength=n)
        kinds = [_per_row(at, np.flatnonzero(t[b]), n) for t in (_SYMBOL, *_TABLES.values())]
        parts.append([words, chars, kinds[0], dup, repeat, lines, kinds[1], kinds[2], distinct, kinds[3]])
    if not parts:
        return [np.zeros(0, np.int64)] * 10
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]


_NAMES = [x.split()[0] for x in STATS.split(", ")]
STATS_TYPE = T.StructType([T.StructField(x, T.LongType()) for x in _NAMES])


def _stats(column: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in text_stats(column)], names=_NAMES)


def stats_of(text: Column) -> Column:
    """Struct of STATS; null and empty texts have zeros."""
    return F.arrow_udf(_stats, STATS_TYPE)(text)


def base_failed(stats: Column, least_words: int = 50, most_repeated: int = 50) -> Column:
    return (stats["n_words"] < least_words) | (100 * stats["n_repeat_words"] > most_repeated * stats["n_words"])


def features_of(stats: Column) -> dict[str, Column]:
    """Ratios that the rules are about, as columns over a struct of STATS."""
    n = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(stats["word_chars"], F.lit(1)).cast("double")
    lines = F.greatest(stats["n_lines"], F.lit(1)).cast("double")
    values = (
        stats["n_words"].cast("double"),
        stats["word_chars"] / n,
        stats["n_symbols"] / n,
        stats["n_dup_lines"] / lines,
        stats["n_repeat_words"] / n,
        stats["n_upper"] / chars,
        stats["n_digits"] / chars,
        stats["n_distinct"] / n,
        stats["n_marks"] / n,
        stats["n_words"] / lines,
    )
    return dict(zip(FEATURES, values, strict=True))


class DecisionList:
    """Rules (conditions, reject?) in order; the first that holds decides, else the text is kept."""

    def __init__(self, rules: list[tuple[list[tuple[str, str, float]], bool]]):
        self.rules = rules

    def rejected(self, features: dict[str, Column]) -> Column:
        out = None
        for conditions, reject in self.rules:
            met = F.lit(True)
            for name, side, bound in conditions:
                met = met & (features[name] >= bound if side == ">=" else features[name] < bound)
            out = F.when(met, F.lit(reject)) if out is None else out.when(met, F.lit(reject))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))


def _met(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, side, bound in conditions:
        out &= x[:, j] >= bound if side == ">=" else x[:, j] < bound
    return out


def _value(hit: np.ndarray, bad: np.ndarray) -> float:
    """Share of rejects among rows hit, drawn towards 0 for few rows."""
    return hit[bad].sum() / (hit.sum() + 4)


def learn_rules(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, least: int = 8, most_rules: int = 24) -> DecisionList:
    """Sequential covering: grow by FOIL gain on two thirds of the rows left, prune on the other third."""
    rules = []
    left = np.ones(len(x), bool)
    fold = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and bad[left].sum() >= least:
        grow, prune = left & ~fold, left & fold
        inside, conditions = grow.copy(), []
        while len(conditions) < 4 and (~bad[inside]).any():
            p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
            best = (0.0, None)
            for j in range(x.shape[1]):
                cuts = np.unique(np.quantile(x[inside][:, j], np.linspace(0, 1, 65)))
                # midpoints between neighbouring values generalise better than the values
                for c in (cuts[1:] + cuts[:-1]) / 2:
                    for side in (">=", "<"):
                        hit = inside & (x[:, j] >= c if side == ">=" else x[:, j] < c)
                        p = bad[hit].sum()
                        if p < least:
                            continue
                        gain = p * (np.log2(p / hit.sum()) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (j, side, float(c)))
            if best[1] is None:
                break
            conditions.append(best[1])
            inside = grow & _met(x, conditions)
        if not conditions:
            break
        while len(conditions) > 1 and _value(prune & _met(x, conditions[:-1]), bad) >= _value(prune & _met(x, conditions), bad):
            conditions.pop()
        hit = left & _met(x, conditions)
        if hit.sum() == 0 or bad[hit].mean() < precision or bad[hit & fold].sum() < 1:
            break
        rules.append(([(FEATURES[j], side, bound) for j, side, bound in conditions], True))
        left &= ~_met(x, conditions)
    return DecisionList(rules)


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """Learns from at most `sample` labelled rows whose crc32(doc_id) mod 5 is not 0, those with the smallest hash of doc_id.

    Rows without label or text teach nothing. A label 0 stands for reject. Where
    a document has several labels it is a reject if any says so. Without rejects the list is empty and keeps all.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("good"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "good", stats_of(F.col("text")).alias("stats"))
    rows = rows.select("doc_id", "good", base_failed(F.col("stats")).alias("failed"), *[v.alias(k) for k, v in features_of(F.col("stats")).items()])
    # of rows that repeat a doc_id one comes to the driver, one that passes the base rule if any does.
    # Those that fail it are left out there: a filter in Spark would have the statistics counted twice
    one = rows.groupBy("doc_id").agg(F.max("good").alias("good"), F.min(F.struct("failed", *FEATURES)).alias("v"))
    pdf = one.select("doc_id", "good", "v.*").toPandas()
    pdf = pdf[~pdf["failed"]].sort_values("doc_id")
    return learn_rules(pdf[list(FEATURES)].to_numpy(float), (pdf["good"] == 0).to_numpy())


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with `_stats`, `_base_failed` and `_kept` added; columns of these three names are replaced.

    Null and empty texts have no words and so fail the base rule.
    """
    out = docs.withColumn("_stats", stats_of(F.col(text_col)))
    return out.withColumns({"_base_failed": base_failed(F.col("_stats")), "_kept": ~base_failed(F.col("_stats")) & ~rules.rejected(features_of(F.col("_stats")))})
