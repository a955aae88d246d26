"""Operator 9: language identification by nearest centroid.

Texts are normalised TF-IDF vectors of hashed byte n-grams. Each language has
several centroids, clustered from a bounded sample of labelled texts; a text
takes the language of the centroid with the highest cosine, and is marked as
rejected if it is further from it than nearly all texts it was learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.workspace import small_batches
from tidemark.llm.words import SPACE, Text, mixed, slices

#: Labelled texts of a language from which centroids are learned, at most; those with the smallest hash of doc_id.
SAMPLE = 1_000
CENTROIDS = 3
SIZES = (1, 2, 3)
BUCKETS = 1 << 12
#: Share of the texts of a language that lie beyond its rejection distance.
BEYOND = 0.005
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER[SPACE] = 32
_LOWER[[*range(33, 65), *range(91, 97), *range(123, 127)]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

#: Texts of all languages together that are brought to the driver, 8 KB each.
TOTAL = 6_000
#: Parts of a language among which its sample is looked for.
PARTS = 64
#: Rows whose dense counts a worker holds at once.
ROWS = 512


def term_counts(text: Text, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed n-grams of bytes, A-Z lower-cased, digits, marks and spaces all alike; one row per text."""
    b = _LOWER[text.bytes]
    row = np.repeat(np.arange(text.n), np.diff(text.at))
    out = np.zeros(text.n * buckets, np.float32)
    gram = np.zeros(len(b), np.uint64)
    for k in range(1, max(SIZES) + 1):
        m = len(b) - k + 1
        if m <= 0:
            break
        gram = (gram[:m] << np.uint64(8)) | b[k - 1 :]
        if k not in SIZES:
            continue
        whole = row[:m] == row[k - 1 :]
        at = (mixed(gram + np.uint64(k << 32)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
        out += np.bincount((row[:m] * buckets + at)[whole], minlength=len(out)).astype(np.float32)
    return out.reshape(text.n, buckets)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log-scaled counts times idf; a text without n-grams stays zero."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(text: Text) -> np.ndarray:
    out = np.bincount(np.searchsorted(text.at[1:], np.flatnonzero(_LETTER[text.bytes]), side="right"), minlength=text.n)[: text.n] > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in text.bytes[text.at[i] : text.at[i + 1]].tobytes().decode("utf-8"))
    return out


def spherical_means(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Unit centroids of at most k clusters, begun from texts far from each other."""
    rng = np.random.default_rng(seed)
    centre = x[[rng.integers(len(x))]]
    while len(centre) < min(k, len(x)):
        centre = np.vstack([centre, x[np.argmin((x @ centre.T).max(axis=1))]])
    for _ in range(rounds):
        of = np.argmax(x @ centre.T, axis=1)
        centre = np.vstack([x[of == j].mean(axis=0) for j in range(len(centre)) if (of == j).any()])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


class Centroids:
    """Unit centroids, the language of each, idf weights, and each language's least cosine."""

    def __init__(self, langs: list[str], centre: np.ndarray, of: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.langs, self.centre, self.of, self.idf, self.least = langs, centre, of, idf, least

    def nearest(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine for each text."""
        close = weighted(term_counts(text), self.idf) @ self.centre.T
        best = np.argmax(close, axis=1)
        return self.of[best], np.clip(close[np.arange(text.n), best], 0, 1)


def fit_centroids(docs: DataFrame, sample: int = SAMPLE, per: int = CENTROIDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids | None:
    """Learns from at most `sample` texts of each language whose crc32(doc_id) mod 5 is not 0, and TOTAL of all; None if there are none.

    More languages than TOTAL are an error. Of rows that repeat doc_id and lang
    the one whose text sorts first teaches.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).isNotNull().alias("_some"))
    known = known.filter(F.col("lang").isNotNull() & F.col("_some") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    small_batches(docs.sparkSession)
    n_langs = max(1, known.select("lang").distinct().count())
    if n_langs > TOTAL:
        raise ValueError(f"{n_langs} languages, more than {TOTAL}")
    sample = min(sample, TOTAL // n_langs)
    # those with the smallest hash, first in parts of a language, then of the parts' own ones
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    for by in (["lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))], ["lang"]):
        known = known.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= sample)
    known = known.select("doc_id", "lang").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null")
    # of rows that repeat both, the first text: no more than one row of a document comes to the driver
    texts = texts.join(F.broadcast(known), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def vectors(batches):
        for batch in batches:
            packed = [row.astype(np.float16).tobytes() for text in slices(batch.column(1), rows=ROWS) for row in np.minimum(term_counts(text), 60_000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "lang", "x"])

    rows = texts.select("doc_id", "text", "lang").mapInArrow(vectors, "doc_id long, lang string, x binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.doc_id))
    if not rows:
        return None
    counts = np.vstack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    lang = np.array([r.lang for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(counts, idf)
    langs = sorted(set(lang.tolist()))
    centre, of, least = [], [], []
    for j, name in enumerate(langs):
        mine = x[lang == name]
        c = spherical_means(mine, per)
        centre.append(c)
        of += [j] * len(c)
        least.append(np.quantile((mine @ c.T).max(axis=1), BEYOND))
    return Centroids(langs, np.vstack(centre).astype(np.float32), np.array(of), idf, np.array(least))


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def language_of(docs: DataFrame, model: Centroids | None, text: Column) -> Column:
    """Struct of lang_pred, score (cosine, 0 to 1) and rejected.

    Texts that are null or have no letter are `und` with score 0, rejected; so
    are all if nothing was learned. Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        m = shared.value
        names, score, rejected = [], [], []
        for part in slices(column, rows=ROWS):
            letters = has_letter(part)
            if m is None:
                letters[:] = False
                of, near = np.zeros(part.n, int), np.zeros(part.n)
            else:
                of, near = m.nearest(part)
            names += [m.langs[j] if ok else UNKNOWN for j, ok in zip(of, letters, strict=True)]
            score.append(np.where(letters, near, 0.0))
            rejected.append(~letters if m is None else ~letters | (near < m.least[of]))
        whole = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(whole(score, float)), pa.array(whole(rejected, bool))], names=RESULT.names)

    return F.arrow_udf(run, RESULT)(text)
