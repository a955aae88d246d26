"""Operator 13: a Merkle manifest of a table, by time-forward processing.

A node's label says when it is its turn: first the round, then the tree, the
block, and inside a block level and place. Digests are messages to parents,
ordered by label in a priority queue. Across blocks this queue is Spark's sorted
shuffle: each round takes blocks of up to 4096 neighbours of a tree, and a
block's last digest is a message to the next round. Inside a block it is a heap.
A second sweep in reversed order of labels hands each node the rest of the proof
above it, down to the leaves. Three rounds hold 10^10 leaves; a task holds a block.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import FEW, staged

#: A block has 2^BITS nodes.
BITS = 12
#: What a leaf is the digest of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int, bits: int) -> int:
    """Levels that a block of a tree with n nodes in this round has above its own nodes."""
    return bits if n > 1 << bits else max(0, n - 1).bit_length()


def rise(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of all nodes by level; children send theirs to a queue of messages, from which each parent takes what is for it."""
    out: list[list[str]] = [digests] + [[] for _ in range(levels)]
    queue = [(1, k >> 1, k & 1, d) for k, d in enumerate(digests)] if levels else []
    while queue:
        level, k, _, d = heapq.heappop(queue)
        if queue and queue[0][:2] == (level, k):
            d += heapq.heappop(queue)[3]
        own = _h(d)
        out[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, k >> 1, k & 1, own))
    return out


def fall(nodes: list[list[str]], above: str) -> list[str]:
    """Per node of the lowest level the way from it to the root: at each level L or R and the sibling on that side, or - where there is none."""
    ways = [above]
    for level in reversed(nodes[:-1]):
        ways = [("-" if k ^ 1 >= len(level) else ("L" if k & 1 else "R") + level[k ^ 1]) + ways[k >> 1] for k in range(len(level))]
    return ways


def fold(digest: str, way: str) -> tuple[str, str]:
    """The root that a leaf's digest leads to, and the siblings on its way, joined."""
    at, siblings = 0, []
    while at < len(way):
        side, sibling = way[at], way[at + 1 : at + 65]
        if side == "-":
            at, digest = at + 1, _h(digest)
        else:
            at, digest = at + 65, _h(sibling + digest if side == "L" else digest + sibling)
            siblings.append(sibling)
    return digest, "".join(siblings)


def leaf_digest(n_chars: Column | None = None) -> Column:
    """Digest of a row's FIELDS (binary): `-` for null, else bytes, `:` and value; n_chars may be given instead of its own."""

    def said(name: str) -> Column:
        c = (F.col(f"`{name}`") if name != "n_chars" or n_chars is None else n_chars).cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.unhex(F.sha2(F.concat(*[said(f) for f in FIELDS]), 256))


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df with `at`, the place of each row in its tree by `order` from 0, and `n`, the rows of its tree.

    Rows are dealt by range, so a tree of any size is many tasks; ties are told
    apart by a running number. Only counts by task and tree are added up.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [tree, *order, "_tie"]
    rows = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    rows = staged(rows.withColumn("_serial", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_task", F.shiftright("_serial", 33))
    pieces = rows.groupBy("_task", tree).agg(F.count("*").alias("_here"), F.min("_serial").alias("_first"))
    pieces = pieces.selectExpr("_task", tree, "_first", f"coalesce(sum(_here) OVER (PARTITION BY {tree} ORDER BY _task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before", f"sum(_here) OVER (PARTITION BY {tree}) AS n")
    pieces = staged(pieces, "pieces")
    found = rows.join(F.broadcast(pieces) if pieces.count() <= FEW else pieces, ["_task", tree])
    return found.withColumn("at", F.col("_serial") - F.col("_first") + F.col("_before")).drop("_serial", "_task", "_first", "_before")


_NODE = "tree string, block long, at long, n long, digest binary"


def _sorted(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    table = table.sort_by("at")
    return table, [d.hex() for d in table["digest"].to_pylist()], table["n"][0].as_py()


def _risen(bits: int):
    def run(table):
        _, digests, n = _sorted(table)
        top = rise(digests, levels_of(n, bits))[-1][0]
        at = table["block"][0].as_py()
        one = {"tree": table["tree"][0].as_py(), "block": at >> bits, "at": at, "n": ((n - 1) >> bits) + 1, "digest": bytes.fromhex(top)}
        return pa.Table.from_pylist([one], schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    return run


def rounds(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """nodes (tree, block, at, n, digest), and what each round makes of them until every tree is one node; one round at least."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while len(out) == 1 or most > 1:
        out.append(staged(out[-1].groupBy("tree", "block").applyInArrow(_risen(bits), _NODE), "nodes"))
        most = ((most - 1) >> bits) + 1
    return out


def _fallen(bits: int):
    def run(nodes, messages):
        table, digests, n = _sorted(nodes)
        ways = fall(rise(digests, levels_of(n, bits)), messages["way"][0].as_py())
        return pa.table({"tree": table["tree"], "block": table["at"], "way": pa.array(ways, pa.string()), "subroot": pa.array([messages["subroot"][0].as_py()] * len(ways), pa.binary())})

    return run


def _proved(bits: int):
    def run(nodes, messages):
        table, digests, n = _sorted(nodes)
        ways = fall(rise(digests, levels_of(n, bits)), messages["way"][0].as_py())
        start = [d if t is None else t.hex() for d, t in zip(digests, table["tampered"].to_pylist(), strict=True)]
        folded, siblings = zip(*[fold(d, w) for d, w in zip(start, ways, strict=True)], strict=True)
        return pa.table({"doc_id": table["doc_id"], "leaf": pa.array(digests), "subroot": pa.array([messages["subroot"][0].as_py().hex()] * len(ways)), "proof_sha256": pa.array([_h(s) for s in siblings]), "folded_root": pa.array(folded)})

    return run


_MESSAGE = "tree string, block long, way string, subroot binary"


def _handed_down(nodes: DataFrame, messages: DataFrame, task, schema: str) -> DataFrame:
    return nodes.groupBy("tree", "block").cogroup(messages.groupBy("tree", "block")).applyInArrow(task, schema)


def merkle_manifest(docs: DataFrame, tampers: Column | None = None, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs (columns FIELDS).

    Leaves of a lang are in order of doc_id, its tree's last digest is the
    subroot; subroots in order of lang make the tree of the root. Where
    `tampers` holds, the row is folded with one added to n_chars, so it is
    verified only if that is null; others prove themselves. Null doc_ids come
    first, rows with equal doc_ids in order of their digests; repeated rows are
    a leaf each. Nulls and empty texts have different digests. An empty table
    gives no rows; columns other than FIELDS are in no digest.
    """
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    tampered = F.when(F.coalesce(tampers if tampers is not None else F.lit(False), F.lit(False)), leaf_digest(F.col("n_chars") + 1))
    leaves = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_digest().alias("digest"), tampered.alias("tampered")), "leaves")
    block = F.shiftright("at", bits).alias("block")
    leaves = staged(numbered(leaves, "tree", ["doc_id", "digest"]).select("tree", block, "at", "n", "digest", "doc_id", "tampered"), "leaves")
    low = rounds(leaves.select("tree", "block", "at", "n", "digest"), bits)
    subroots = low[-1].select(F.lit("").alias("top"), F.col("tree").alias("lang"), F.col("digest").alias("subroot"))
    subroots = staged(numbered(subroots, "top", ["lang"]).select(F.col("top").alias("tree"), block, "at", "n", F.col("subroot").alias("digest"), "lang"), "subroots")
    high = rounds(subroots.select("tree", "block", "at", "n", "digest"), bits)
    root = high[-1].select(F.lower(F.hex("digest"))).first()
    messages = high[-1].select("tree", F.col("at").alias("block"), F.lit("").alias("way"), F.col("digest").alias("subroot"))
    for nodes in reversed(high[:-1]):
        messages = staged(_handed_down(nodes, messages, _fallen(bits), _MESSAGE), "ways")
    messages = subroots.select("at", F.col("lang").alias("tree"), F.col("digest").alias("subroot")).join(messages.select(F.col("block").alias("at"), "way"), "at")
    messages = messages.select("tree", F.lit(0).cast("long").alias("block"), "way", "subroot")
    for nodes in reversed(low[1:-1]):
        messages = staged(_handed_down(nodes, messages, _fallen(bits), _MESSAGE), "ways")
    out = _handed_down(leaves, messages, _proved(bits), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(root[0] if root else None).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
