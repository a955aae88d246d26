"""Operator 3: token counts of sections by offset-mapped attribution.

Each document is encoded once, whole. Byte spans of its tokens are joined to
the byte spans of its sections, and a token that crosses a boundary belongs to
the section that holds its first byte.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import slices

RESULT = T.StructType([T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("section_tokens", "section_bytes", "crossing")] + [T.StructField("n_tokens", T.LongType())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Mergeable ranks of a .tiktoken file, read on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_last: list = [None, None]


def _encoding(shared):
    """The encoding of this worker and its tokens' lengths, made anew when it gets other ranks."""
    if _last[0] is not shared.value:
        import tiktoken

        pattern, ranks = shared.value
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _last[:] = shared.value, (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _last[1]


def attribute(token_begin: np.ndarray, token_end: np.ndarray, section_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that begin in each section, and of these the ones that end in a later one."""
    of = np.searchsorted(section_begin, token_begin, side="right") - 1
    last = np.searchsorted(section_begin, token_end - 1, side="right") - 1
    n = len(section_begin)
    return np.bincount(of, minlength=n), np.bincount(of[last > of], minlength=n)


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (from 0), n_bytes, n_tokens, n_crossing, doc_tokens; one row per line of every text.

    A section is a line with its newline at the end, so sections cover the text
    and their tokens add up to doc_tokens. Null and empty texts have one empty
    section. Rows that repeat a doc_id are counted each for itself. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pattern, read_ranks(ranks_path)))

    def run(column: pa.Array) -> pa.Array:
        encoding, lengths = _encoding(shared)
        tokens, sizes, crossing, total = [], [], [], []
        for text in slices(column):
            newline = np.flatnonzero(text.bytes == 10) + 1
            for i in range(text.n):
                first, last = text.at[i], text.at[i + 1]
                ids = encoding.encode_ordinary(text.bytes[first:last].tobytes().decode("utf-8"))
                end = np.cumsum(lengths[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
                begin = np.concatenate([[0], end[:-1]]) if ids else end
                mine = newline[np.searchsorted(newline, first, side="right") : np.searchsorted(newline, last)] - first
                starts = np.concatenate([[0], mine])
                n, over = attribute(begin, end, starts)
                tokens.append(n)
                crossing.append(over)
                sizes.append(np.diff(np.append(starts, last - first)))
                total.append(len(ids))
        as_lists = lambda x: pa.array([y.astype(np.int32) for y in x], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([as_lists(tokens), as_lists(sizes), as_lists(crossing), pa.array(total, pa.int64())], names=RESULT.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(run, RESULT)(F.col(text_col)).alias("_c"))
    parts = F.posexplode(F.arrays_zip("_c.section_tokens", "_c.section_bytes", "_c.crossing"))
    rows = rows.select("doc_id", F.col("_c.n_tokens").alias("doc_tokens"), parts.alias("section", "_s"))
    return rows.select(
        "doc_id",
        "section",
        F.col("_s.section_bytes").cast("long").alias("n_bytes"),
        F.col("_s.section_tokens").cast("long").alias("n_tokens"),
        F.col("_s.crossing").cast("long").alias("n_crossing"),
        "doc_tokens",
    )
