"""Operator 11: near duplicates by SimHash, linked through fuzzy keys of the binary Golay code.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that
differ in three bits or fewer, either some segment is equal, and then one of the
other two has one wrong bit at most, or each segment has exactly one. In the
first case a key is the equal segment with the codeword that the other decodes
to; in the second the first two segments each have a half that is equal, and the
key is these halves with the codeword of the third: ten keys in all.

Every word of 23 bits is within three bits of exactly one codeword of the Golay
code. A segment is filed under the number of that codeword and sought under
those of all codewords within four bits, which are one or six: a segment with one
bit changed is still within four of the codeword that the other decodes to, so
both meet. Keys have 33 or 34 bits, so chance meetings stay rare up to billions
of fingerprints; whoever meets is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.workspace import attach_groups, small_batches, staged
from tidemark.llm.words import Text, slices

SEED = 42
#: Most bits in which linked fingerprints differ; the keys are made for it.
MOST = 3
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code of length 23.
GENERATOR = 0xAE3
#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that a task compares at once; a key with more is cut into blocks.
BLOCK = 8192
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each message, and by remainder the error patterns of up to four bits, lightest first (zeros after the first: no more)."""
    rest = np.arange(1 << 23, step=1 << 11, dtype=np.int64)
    for bit in range(22, 10, -1):
        rest ^= (rest >> bit & 1) * (GENERATOR << (bit - 11))
    patterns = np.zeros((1 << 11, 6), np.int64)
    found = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(rest[e >> 11]) ^ (e & 2047)
            patterns[s, found[s]] = e
            found[s] += 1
    return rest, patterns


REST, PATTERNS = _golay()


def codewords(words: np.ndarray) -> np.ndarray:
    """Numbers of the codewords within four bits of each word: the nearest one first, then five more or -1."""
    e = PATTERNS[REST[words >> 11] ^ (words & 2047)]
    found = (words[:, None] ^ e) >> 11
    found[:, 1:][e[:, 1:] == 0] = -1
    return found


def _part(fp: np.ndarray, first: int, length: int) -> np.ndarray:
    return (fp >> np.uint64(first) & np.uint64((1 << length) - 1)).astype(np.int64)


def keys(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind of key: the key under which each fingerprint is filed, and those (five columns, -1 for none) under which it is also sought."""
    parts = [_part(fp, *s) for s in SEGMENTS]
    near = [codewords(p) for p in parts]
    halves = [(_part(fp, at, n // 2), _part(fp, at + n // 2, n - n // 2)) for at, n in SEGMENTS[:2]]
    kinds = [(parts[x], near[y]) for x in range(3) for y in range(3) if x != y]
    kinds += [(a << 11 | b, near[2]) for a in halves[0] for b in halves[1]]
    for kind, (exact, words) in enumerate(kinds):
        all_ = np.where(words < 0, -1, np.int64(kind) << 40 | exact[:, None] << 12 | words)
        yield all_[:, 0], all_[:, 1:]


def _shingle_hashes(text: Text, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of `width` words (of all words, where a row has fewer), and its row."""
    start, end, row = text.words()
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    count = np.diff(np.r_[first, len(row)])
    last = np.arange(len(row)) + width - 1
    whole = last < np.repeat(first + count, count)
    short = first[count < width]
    begin, stop = np.r_[np.flatnonzero(whole), short], np.r_[last[whole], short + count[count < width] - 1]
    data, place = text.spaced()
    a, size = place[start[begin]], end[stop] - 1
    b = place[size] + 1
    data = data.tobytes()
    h = np.fromiter((xxhash.xxh64_intdigest(data[i:j], SEED) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    order = np.argsort(row[begin], kind="stable")
    return h[order], row[begin][order]


def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """SimHash of each text: a bit is 1 if it is in over half of the hashes of its shingles; 0 without words."""
    out = np.zeros(len(texts), np.uint64)
    for text in slices(texts):
        h, row = _shingle_hashes(text, width)
        ones, of = np.zeros((text.n, 64), np.int64), np.bincount(row, minlength=text.n)
        for k in range(0, len(h), CHUNK):
            bits = np.unpackbits(h[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = row[k : k + CHUNK]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            ones[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[text.first : text.first + text.n] = np.packbits(2 * ones > of[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprinted(width: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), width).view(np.int64))], names=["doc_id", "fp"])

    return run


def _postings(batches):
    """A row per fingerprint and key; home where it is filed, not only sought."""
    for b in batches:
        own = np.asarray(b.column(0))
        for home, more in keys(own.view(np.uint64)):
            at, which = np.nonzero(more >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[home, more[at, which]]), pa.array(np.r_[own, own[at]]), pa.array(np.arange(len(own) + len(at)) < len(own))],
                names=["key", "fp", "home"],
            )


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what steps of at most MOST bits connect: one fewer than members in each class."""
    left, a, b = np.unique(fp), [], []
    front = left[:0]
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
            continue
        by = np.full(len(left), -1)
        for k in range(0, len(front), 256):
            open_ = np.flatnonzero(by < 0)
            near = np.bitwise_count(front[k : k + 256, None] ^ left[None, open_]) <= MOST
            hit = near.any(axis=0)
            by[open_[hit]] = k + near[:, hit].argmax(axis=0)
        a.append(front[by[by >= 0]])
        b.append(left[by >= 0])
        front, left = left[by >= 0], left[by < 0]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(batches):
    """Links inside each run of rows with the same key and block; a run may go on in the next batch."""

    def of(columns):
        edge = np.flatnonzero((columns[:3, 1:] != columns[:3, :-1]).any(axis=0)) + 1
        found = [forest(g.view(np.uint64)) for g in np.split(columns[3], edge) if len(g) > 1]
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    kept = np.zeros((4, 0), np.int64)
    for batch in batches:
        kept = np.concatenate([kept, np.stack([np.asarray(c) for c in batch.columns])], axis=1)
        edge = np.flatnonzero((kept[:3] != kept[:3, -1:]).any(axis=0))
        done = edge[-1] + 1 if len(edge) else 0
        yield from of(kept[:, :done])
        kept = kept[:, done:]
    yield from of(kept)


def hamming_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between fingerprints of `distinct` (column fp) that connect all that differ in at most MOST bits.

    Keys under which one fingerprint only is found, or none is filed, go after
    the count. Members of a key are compared inside tasks, which return a forest
    of links and no pairs; a key with more than `block` members is cut into
    blocks, and each two of these meet in a task of their own.
    """
    postings = distinct.select("fp").mapInArrow(_postings, "key long, fp long, home boolean")
    met = postings.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("filed")).filter("n > 1 and filed")
    # Spark takes what a task makes of a small table for small: the merge hint keeps postings off the driver
    rows = postings.select("key", "fp").join(met.select("key", "n").hint("merge"), "key")
    blocks = F.ceil(F.col("n") / block)
    rows = rows.select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("own"))
    rows = rows.select("key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return rows.mapInArrow(_links, "a long, b long")


def simhash_classes(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and copies (rows with that fingerprint) of every row of docs.

    component_id is the smallest doc_id reachable over links of at most three
    bits, the row's own included; null where no row of its class has a doc_id.
    Null and empty texts and texts without words have fingerprint zero and are
    linked like any other. Repeated rows are each returned, an empty table gives
    no rows, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(rows.mapInArrow(_fingerprinted(width), "doc_id long, fp long"), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "distinct")
    comp = components(hamming_links(distinct, block))
    named = distinct.join(comp.toDF("fp", "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    groups = staged(named.join(lowest, "comp").select("fp", "copies", "component_id"), "classes")
    out = attach_groups(rows, groups, "fp", "copies", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
