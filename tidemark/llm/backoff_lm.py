"""Operator 7: scoring by a weighted backoff automaton of smoothed n-grams.

States are the root, one per word and one per pair of words that training has.
An arc of a state carries the log-probability of a word seen
after it; its failure arc, with the backoff weight, leads from a pair to its
last word and from a word to the root. The corpus may have more arcs than fit
anywhere, so texts are packed into chunks, and each chunk gets the part of the
automaton that its own texts walk through, with weights from counts over the
whole corpus: it sends what it has, contexts and the words that follow them, to
buckets by hash, and each bucket answers with totals in the order in which it
was asked; first for pairs, then for triples behind the pairs that are states.
A pair that no other chunk has is not asked about again: what follows it is all
in its own chunk.
"""

from __future__ import annotations

import math
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import mixed, slices
from tidemark.llm.workspace import small_batches, staged

#: What follows a context with this share of sampled tokens is dealt over all buckets, what follows any other lies in its own. No result depends on it.
STATE_SHARE = 2e-4
#: At most one in so many chunks' worth of texts is looked at for these words.
SAMPLE = 64
CHUNK_BYTES = 7 << 20
#: Bytes of text behind a bucket, on average: what a task adds up at once is some ten times as much.
BUCKET_BYTES = 4 << 20
END = np.uint64(0x5BD1E9955BD1E995)


def _tokens(column: pa.Array):
    """Per slice of the column: first row, number of rows, token hashes and the row of each; every row ends in END."""
    for text in slices(column):
        start, end, row = text.words()
        h = text.hashes(start, end, fold=True)
        cut = np.searchsorted(row, np.arange(1, text.n + 1))
        yield text.first, text.n, np.insert(h, cut, END), np.insert(row, cut, np.arange(text.n))


def _find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in sorted keys, -1 where it isn't there."""
    if len(keys) == 0:
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) + np.uint64(0x9E3779B97F4A7C15) ^ second)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=weights, minlength=len(unique)).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def _frequent(share: float):
    """Words and pairs of words that hold a quarter of `share` or more of a task's tokens, and the task's token count (word null)."""

    def run(batches):
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for _, _, h, row in _tokens(batch.column(0)):
                total += len(h)
                both = np.concatenate([h, _pair_key(h[:-1], h[1:])[row[1:] == row[:-1]]])
                fresh.append(_summed(both, np.ones(len(both))))
                waiting += len(fresh[-1][0])
                if waiting > max(1 << 20, len(keys)):
                    keys, counts = _merged([(keys, counts), *fresh])
                    fresh, waiting = [], 0
        keys, counts = _merged([(keys, counts), *fresh])
        top = counts >= max(1, share / 4 * total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[top].view(np.int64), 0), mask=np.append(np.zeros(top.sum(), bool), True)), pa.array(np.append(counts[top], total))], names=["word", "n"])

    return run


def _packed(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return kind.char.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), data[:1].decode()).astype(np.int64)


class Asks:
    """Contexts and what follows them, each with its training count, in the order in which buckets are asked.

    Within a bucket, what follows a spread context comes last.
    """

    def __init__(self, keys: np.ndarray, key_n: np.ndarray, first: np.ndarray, second: np.ndarray, pair_n: np.ndarray, spread: np.ndarray, buckets: int):
        self.keys, self.key_n, self.first, self.second, self.pair_n, self.buckets = keys, key_n, first, second, pair_n, buckets
        self.spread = _find(spread, keys)
        n = np.uint64(buckets)
        home = (mixed(keys) % n).astype(np.int64)
        self.wide = self.spread[first]
        dealt = (mixed(mixed(keys[first]) ^ second) % n).astype(np.int64)
        place = np.where(self.wide >= 0, dealt, home[first])
        self.key_order = np.argsort(home, kind="stable")
        self.pair_order = np.lexsort((first, self.wide >= 0, place))
        every = np.arange(buckets + 1)
        self.key_cut = np.searchsorted(home[self.key_order], every)
        self.pair_cut = np.searchsorted(place[self.pair_order], every)

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.key_order[self.key_cut[k] : self.key_cut[k + 1]], self.pair_order[self.pair_cut[k] : self.pair_cut[k + 1]]

    def sent(self, number: int) -> pa.RecordBatch:
        """One row per bucket that is asked: keys, their counts and numbers of followers, followers, their counts, and the spread key before each of the last ones."""
        out: dict[str, list] = {k: [] for k in ("bucket", "words", "word_n", "follow", "second", "pair_n", "wide")}
        # those alone that something is sent to: a chunk's work does not grow with the number of buckets
        for k in np.flatnonzero(np.diff(self.key_cut) + np.diff(self.pair_cut)):
            w, p = self.part(k)
            if len(w) + len(p):
                wide = self.wide[p]
                follow = np.bincount(np.searchsorted(w, self.first[p[wide < 0]]), minlength=len(w))
                row = (k, self.keys[w].tobytes(), _packed(self.key_n[w]), _packed(follow), self.second[p].tobytes(), _packed(self.pair_n[p]), _packed(wide[wide >= 0]))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        columns = [pa.array(np.full(len(out["bucket"]), number), pa.int64()), *[pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()]]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", *out])

    def totals(self, answers: list[dict], spread_kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Training totals of keys and followers, how many kinds of words follow each key, and which followers other chunks have too, from the buckets' answers."""
        pair_n, key_n, kinds = np.zeros(len(self.first), np.int64), np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        shared = np.zeros(len(self.first), bool)
        for r in answers:
            w, p = self.part(r["bucket"])
            pair_n[p], key_n[w], kinds[w] = _unpacked(r["pair_n"]), _unpacked(r["word_n"]), _unpacked(r["kinds"])
            shared[p] = _unpacked(r["shared"]) > 0
        wide = self.spread >= 0
        kinds[wide] = spread_kinds[self.spread[wide]]
        return key_n, pair_n, kinds, shared


ASKED = "chunk long, bucket int, words binary, word_n binary, follow binary, second binary, pair_n binary, wide binary"


class Chunk:
    """Tokens of a chunk's texts; its distinct words, pairs and triples of neighbours, each with its training count."""

    def __init__(self, rows: pa.Table):
        held = np.asarray(rows.column("held_out").to_numpy(zero_copy_only=False), bool)
        texts = rows.column("text").combine_chunks()
        self.n = len(held)
        parts = [(h, (first + row).astype(np.int32)) for first, _, h, row in _tokens(texts)]
        h, self.row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        del parts
        self.train = ~held[self.row]
        self.words, of = np.unique(h, return_inverse=True)
        del h
        self.of = of.astype(np.int32)
        width = max(len(self.words), 1)
        self.word_n = np.bincount(self.of[self.train], minlength=len(self.words))
        #: Place of the pair that a token ends, -1 for a text's first.
        self.pair_at = np.full(len(self.of), -1, np.int32)
        inside = np.flatnonzero(self.row[1:] == self.row[:-1]) + 1
        pairs, at = np.unique(self.of[inside - 1].astype(np.int64) * width + self.of[inside], return_inverse=True)
        self.pair_at[inside] = at
        self.pair_n = np.bincount(at[self.train[inside]], minlength=len(pairs))
        self.first = (pairs // width).astype(np.int32)
        self.second = (pairs - self.first.astype(np.int64) * width).astype(np.int32)

    def asks(self, spread: np.ndarray, buckets: int) -> Asks:
        return Asks(self.words, self.word_n, self.first, self.words[self.second], self.pair_n, spread, buckets)

    def deepen(self, pair_total: np.ndarray, shared: np.ndarray) -> None:
        """Makes states of the pairs that training has, and finds the triples behind them; what follows a pair that is not shared is known here."""
        self.deep = np.flatnonzero((pair_total > 0) & (self.words[self.second] != END))
        slot = np.full(len(pair_total), -1, np.int32)
        slot[self.deep] = np.arange(len(self.deep))
        before = np.concatenate([[-1], self.pair_at[:-1]])
        #: State before a token, -1 if it isn't a pair, and the place of the triple behind it.
        self.slot_at = np.where((before >= 0) & (self.pair_at >= 0), slot[before], -1)
        inside = np.flatnonzero(self.slot_at >= 0)
        width = max(len(self.words), 1)
        triples, at = np.unique(self.slot_at[inside].astype(np.int64) * width + self.of[inside], return_inverse=True)
        self.triple_at = np.full(len(self.of), -1, np.int32)
        self.triple_at[inside] = at
        self.triple_n = np.bincount(at[self.train[inside]], minlength=len(triples))
        self.slot = (triples // width).astype(np.int32)
        self.third = (triples - self.slot.astype(np.int64) * width).astype(np.int32)
        #: The pair that a triple ends with.
        self.tail = np.zeros(len(triples), np.int32)
        self.tail[at] = self.pair_at[inside]
        #: States to ask about, and the triples behind them.
        self.far = np.flatnonzero(shared[self.deep])
        self.far_triples = np.flatnonzero(shared[self.deep[self.slot]])

    def deep_asks(self, spread: np.ndarray, buckets: int) -> Asks:
        far = self.deep[self.far]
        keys = _pair_key(self.words[self.first[far]], self.words[self.second[far]])
        slot = np.searchsorted(self.far, self.slot[self.far_triples])
        return Asks(keys, self.pair_n[far], slot, self.words[self.third[self.far_triples]], self.triple_n[self.far_triples], spread, buckets)

    def deep_totals(self, asks: Asks, answers: list[dict], spread_kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training totals of all triples, and how many kinds of words follow each state."""
        total = self.triple_n.astype(np.int64)
        kinds = np.bincount(self.slot[self.triple_n > 0], minlength=len(self.deep)).astype(np.int64)
        _, total[self.far_triples], kinds[self.far], _ = asks.totals(answers, spread_kinds)
        return total, kinds


def _chunks(chunk_bytes: int):
    """Rows of a task in chunks of about chunk_bytes of text: a number drawn at random, bytes, and the rows as compressed Arrow data."""

    def run(batches):
        rng = np.random.default_rng()
        waiting: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in waiting:
                    out.write_batch(b)
            number = pa.array([rng.integers(1 << 62)], pa.int64())
            return pa.RecordBatch.from_arrays([number, pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "bytes", "data"])

        for batch in batches:
            waiting.append(batch)
            size += sum(len(x) for x in batch.column(2).buffers()[2:] if x is not None)
            if size >= chunk_bytes:
                yield packed()
                waiting, size = [], 0
        if waiting:
            yield packed()

    return run


def _rows(data) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _asked(spread, buckets: int):
    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield Chunk(_rows(data.as_buffer())).asks(spread.value, buckets).sent(number)

    return run


def _asked_deep(spread, spread_kinds, buckets: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(_rows(chunk.column("data")[0].as_buffer()))
        _, pair_n, _, shared = c.asks(spread.value, buckets).totals(answers.to_pylist(), spread_kinds.value)
        c.deepen(pair_n, shared)
        return pa.Table.from_batches([c.deep_asks(spread.value, buckets).sent(chunk.column("chunk")[0].as_py())])

    return run


def _answered(spread):
    """Totals of a bucket over all chunks.

    One row per chunk that asked: totals of its keys and of what follows them,
    and how many kinds of words follow each key in training (of spread keys in
    this bucket only). With chunk null: the kinds that follow each spread key
    here, and, with spread -1, the sum of the keys' totals, how many keys have
    one, and how many have 1 and 2.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        unique, of = np.unique(np.concatenate(words), return_inverse=True)
        word_n = np.bincount(of, weights=np.concatenate([_unpacked(r["word_n"]) for r in rows]), minlength=len(unique)).astype(np.int64)
        word_cut = np.cumsum([0, *map(len, words)])
        context, second, pair_n, pair_cut = [], [], [], [0]
        for k, r in enumerate(rows):
            context.append(np.repeat(of[word_cut[k] : word_cut[k + 1]], _unpacked(r["follow"])))
            context.append(len(unique) + _unpacked(r["wide"]))
            second.append(np.frombuffer(r["second"], np.uint64))
            pair_n.append(_unpacked(r["pair_n"]))
            pair_cut.append(pair_cut[-1] + len(second[-1]))
        context = np.concatenate(context)
        key = mixed(context.astype(np.uint64) + np.uint64(1)) + np.concatenate(second)
        _, at, pair = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(pair, weights=np.concatenate(pair_n), minlength=len(at)).astype(np.int64)
        shared = np.bincount(pair, minlength=len(at)) > 1
        kinds = np.bincount(context[at], weights=total > 0, minlength=len(unique) + len(spread.value)).astype(np.int64)
        out = []
        for k, r in enumerate(rows):
            p, w = pair[pair_cut[k] : pair_cut[k + 1]], of[word_cut[k] : word_cut[k + 1]]
            out.append({"chunk": r["chunk"], "bucket": r["bucket"], "pair_n": _packed(total[p]), "word_n": _packed(word_n[w]), "kinds": _packed(kinds[w]), "shared": _packed(shared[p].astype(np.uint8))})
        wide = kinds[len(unique) :]
        out += [{"spread": int(k), "n": int(wide[k])} for k in np.flatnonzero(wide)]
        out.append({"spread": -1, "n": int(word_n.sum()), "v": int((word_n > 0).sum()), "n1": int((word_n == 1).sum()), "n2": int((word_n == 2).sum())})
        return pa.Table.from_pylist(out, schema=ANSWER)

    return run


ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("pair_n", pa.binary()), ("word_n", pa.binary()), ("kinds", pa.binary()), ("shared", pa.binary()), ("spread", pa.int32()), *[(k, pa.int64()) for k in ("n", "v", "n1", "n2")]])


class Automaton:
    """log10 weights of arcs and failure arcs, by places in a chunk.

    corpus: training tokens, distinct ones, and the discount. word_n, pair_n and
    triple_n are training totals, follow_n those of words as contexts (nothing
    follows the end); a pair has a first and a second word, a triple a state
    (slot) and the pair it ends with (tail); deep names the pairs that are states.
    """

    def __init__(self, corpus, word_n, follow_n, kinds, first, second, pair_n, deep, deep_kinds, slot, tail, triple_n):
        total, distinct, discount = corpus
        with np.errstate(divide="ignore", invalid="ignore"):
            unknown = math.log10(discount * distinct / total) if total else 0.0
            self.root = np.where(word_n > 0, np.log10((word_n - discount) / max(total, 1)), unknown)
            self.fail, self.arc = self._level(discount, follow_n, kinds, first, pair_n, self.root[second])
            self.deep_fail, self.deep_arc = self._level(discount, pair_n[deep], deep_kinds, slot, triple_n, self.arc[tail])

    @staticmethod
    def _level(discount, context_n, kinds, context, n, lower):
        """Failure weight of each context, and weight of each arc: its own share and the failure weight's of the shorter context's."""
        left = discount * kinds / context_n
        fail = np.where(context_n > 0, np.log10(left), 0.0)
        own = np.log10((n - discount) / context_n[context] + left[context] * 10**lower)
        return fail, np.where(n > 0, own, fail[context] + lower)

    def walk(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray, slot: np.ndarray, triple: np.ndarray) -> np.ndarray:
        """Weight of each token: its arc out of the state before it, or that state's failure arc and what the next state gives.

        before is the word before a token (the state that a pair fails to), -1 at
        a text's start; places of pairs, states and triples are -1 where a chunk has none.
        """
        out = self.root[word] + (np.where(before >= 0, self.fail[before], 0.0) if len(self.fail) else 0.0)
        if len(self.arc):
            out = np.where(pair >= 0, self.arc[pair], out)
        if len(self.deep_fail):
            out = out + np.where(slot >= 0, self.deep_fail[slot], 0.0)
        return np.where(triple >= 0, self.deep_arc[triple], out) if len(self.deep_arc) else out


def _scores(model, buckets: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        spread, kinds, deep_kinds, corpus = model.value
        total, distinct, _ = corpus
        rows = _rows(chunk.column("data")[0].as_buffer())
        c, got, rows = Chunk(rows), answers.to_pylist(), rows.select(["doc_id", "held_out"])
        word_n, pair_n, follow_kinds, shared = c.asks(spread, buckets).totals([r for r in got if r["level"] == 2], kinds)
        c.deepen(pair_n, shared)
        triple_n, state_kinds = c.deep_totals(c.deep_asks(spread, buckets), [r for r in got if r["level"] == 3], deep_kinds)
        follow_n = np.where(c.words == END, 0, word_n)
        a = Automaton(corpus, word_n, follow_n, follow_kinds, c.first, c.second, pair_n, c.deep, state_kinds, c.slot, c.tail, triple_n)
        before = np.where(c.pair_at >= 0, np.concatenate([[-1], c.of[:-1]]), -1)
        weight = a.walk(c.of, before, c.pair_at, c.slot_at, c.triple_at)
        seen = word_n[c.of]
        sums = lambda x: np.bincount(c.row, weights=x, minlength=c.n)
        out = {
            "n_tokens": np.bincount(c.row, minlength=c.n),
            "n_known": sums(seen > 0).astype(np.int64),
            "base_score": sums(np.log10((seen + 1) / (total + (distinct + 1)))),
            "score": sums(weight),
        }
        return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "held_out": rows.column("held_out"), **out})

    return run


def held_out(id_col: str = "doc_id", mod: int = 7, rest: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    state_share: float = STATE_SHARE,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Learns from the rows that aren't held out and scores all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probability of the text's words and one end). Words are lower-cased
    (A-Z) runs other than space and 0x09-0x0D. The probability of a word is
    interpolated absolute discounting of triples over pairs over single words; all words never seen are one
    type, with the mass discounted from words, so from every state probabilities
    add up to 1.

    Null texts are empty: their one token is the end. Repeated rows are scored
    each for itself and train each for itself. Without training rows the only
    type is the unknown one, with probability 1. An empty table gives no rows;
    other columns are ignored. Words and pairs are known by 64-bit hashes.
    state_share, like chunk_bytes, only deals out the work.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", held_out("doc_id"))
    packed = docs.select("doc_id", "held_out", "text").mapInArrow(_chunks(chunk_bytes), "chunk long, bytes long, data binary")
    # bucketed by chunk: joins with answers read it in place
    table = f"lm_chunks_{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        packed.write.bucketBy(tasks, "chunk").option("compression", "uncompressed").format("parquet").saveAsTable(table)
        return _scored(docs, spark.table(table), state_share, chunk_bytes)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _scored(docs: DataFrame, packed: DataFrame, state_share: float, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    size = packed.agg(F.sum("bytes")).first()[0] or 0
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // min(BUCKET_BYTES, chunk_bytes)))
    hashed = F.xxhash64("doc_id", F.octet_length("text"))
    some = docs.filter(F.pmod(hashed, F.lit(min(chunks, SAMPLE))) == 0)
    found = staged(some.select("text").mapInArrow(_frequent(state_share), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    tokens = found.filter("word is null").agg(F.sum("n")).first()[0] or 0
    frequent = found.filter(F.col("word").isNotNull() & (F.col("n") >= max(1, state_share * tokens))).select("word")
    keys = np.sort(np.array([r.word for r in frequent.collect()], np.int64).view(np.uint64))
    shared_keys = spark.sparkContext.broadcast(keys)

    answer = "chunk long, bucket int, pair_n binary, word_n binary, kinds binary, shared binary, spread int, n long, v long, n1 long, n2 long"

    def answered(asked: DataFrame, level: int) -> tuple[DataFrame, np.ndarray]:
        """Answers to chunks, and the kinds of words that follow each spread key."""
        rows = staged(asked.groupBy("bucket").applyInArrow(_answered(shared_keys), answer).withColumn("level", F.lit(level)), "answers")
        kinds = np.zeros(len(keys), np.int64)
        for r in rows.filter("spread >= 0").groupBy("spread").agg(F.sum("n").alias("n")).collect():
            kinds[r.spread] = r.n
        return rows, kinds

    def to_chunks(*answers: DataFrame):
        rows = [a.filter("chunk is not null").select("level", "chunk", "bucket", "pair_n", "word_n", "kinds", "shared") for a in answers]
        return packed.select("chunk", "data").groupBy("chunk").cogroup(reduce(DataFrame.unionByName, rows).groupBy("chunk"))

    pairs, kinds = answered(packed.select("chunk", "data").mapInArrow(_asked(shared_keys, buckets), ASKED), 2)
    shared_kinds = spark.sparkContext.broadcast(kinds)
    triples, deep_kinds = answered(to_chunks(pairs).applyInArrow(_asked_deep(shared_keys, shared_kinds, buckets), ASKED), 3)

    stats = pairs.filter("spread = -1").agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).first()
    n, v, n1, n2 = (x or 0 for x in stats)
    discount = min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1)))
    model = spark.sparkContext.broadcast((keys, kinds, deep_kinds, (n, v, discount)))
    scored = to_chunks(pairs, triples).applyInArrow(_scores(model, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = staged(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"), "scores")
    return out
