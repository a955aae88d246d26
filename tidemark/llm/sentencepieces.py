"""Operator 5: exact SentencePiece BPE encoding by backtracking, and decoding.

A BPE encoding is the only sequence of pieces in which every two neighbours,
merged again from their characters, come out as the same two pieces. So the
encoder takes the longest piece (all matches from one Aho-Corasick pass), goes
on if it is compatible with the piece before, else tries a shorter one, and
marks positions from which no continuation exists in a bitfield.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words remembered by each Python worker; beyond that it begins anew.
MEMORY = 500_000
LONGEST_REMEMBERED = 40


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0 normal, 1 byte, 2 control or unknown. Read on the driver and sent to the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class PieceCodec:
    """Encoder and decoder for a BPE model with byte fallback, dummy prefix and no other normalisation."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.pieces = vocabulary
        self.score = {p: s for p, s, kind in vocabulary if kind == 0}
        self.id = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == 0}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == 1}
        self.value = {i: v for v, i in self.byte.items()}
        self.text = {i: p.replace(SPACE, " ") for p, i in self.id.items()}
        self.unknown = next((i for i, (p, _, kind) in enumerate(vocabulary) if kind == 2), 0)
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            # a piece that merging doesn't make of its own characters is never part of an encoding
            if len(p) > 1 and self.merged(p) == [p]:
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[str, int, str]] = {}
        self.bounded = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in self.id)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone))
        self.characters = {p for p in self.id if len(p) == 1}
        #: Neighbouring characters that some piece has; between others no piece reaches.
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}

    def merged(self, text: str) -> list[str]:
        """Merges from single characters: always the best pair, of equals the leftmost."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= len(part) or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > MEMORY:
                self.fits.clear()
            known = self.fits[key] = self.merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces themselves."""
        n = len(text)
        if n < 2:
            return [text] if text else []
        ends: list[list[str] | None] = [None] * n  # pieces by start, longer ones later; single characters go without saying
        for end, (size, piece) in self.automaton.iter(text):
            start = end - size
            if (some := ends[start]) is None:
                ends[start] = [piece]
            else:
                some.append(piece)
        fits, failed = self.fits, bytearray(n // 8 + 1)
        path: list[str] = []
        left: list[int] = []  # how many matches at each piece of the path haven't been tried
        last, at = "", 0
        tries = len(ends[0] or ()) + 1
        while at < n:
            found = ends[at]
            while tries:
                tries -= 1
                piece = found[tries - 1] if tries else text[at]
                to = at + len(piece)
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                if not last or (fits.get((last, piece)) or self.compatible(last, piece)):
                    path.append(piece)
                    left.append(tries)
                    last, at = piece, to
                    if at < n:
                        tries = len(ends[at] or ()) + 1
                    break
            else:
                if not path:
                    raise ValueError("no encoding")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(path.pop())
                tries = left.pop()
                last = path[-1] if path else ""
        return path

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk; characters that are no piece become their UTF-8 bytes."""
        if self.characters.issuperset(chunk):
            return [self.id[p] for p in self.split(chunk)]
        ids: list[int] = []
        run: list[str] = []
        for c in chunk:
            if c in self.id:
                run.append(c)
                continue
            if run:
                ids += [self.id[p] for p in self.split("".join(run))]
                run = []
            if self.byte:
                ids += [self.byte[v] for v in c.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        if run:
            ids += [self.id[p] for p in self.split("".join(run))]
        return ids

    def chunks(self, text: str) -> list[str]:
        """Parts of the prefixed text that no piece crosses."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.bounded:
            return [text]
        parts = self.chunk.findall(text)
        if max(map(len, parts)) > LONGEST_REMEMBERED:
            parts = [x for p in parts for x in (self.cut(p) if len(p) > LONGEST_REMEMBERED else (p,))]
        return parts

    def cut(self, chunk: str) -> list[str]:
        joined = self.joined
        at = [0, *(k + 1 for k in range(len(chunk) - 1) if chunk[k : k + 2] not in joined), len(chunk)]
        return [chunk[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.chunk_ids(chunk)]

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids with the prefix still there; bytes that form no character become U+FFFD, one each."""
        text = self.text
        if all([i in text for i in ids]):
            return "".join([text[i] for i in ids])
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + k].decode("utf-8"))
                        at += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            flush()
            if i in text:
                out.append(text[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_pieces(ids)
        first = ids and self.pieces[ids[0]]
        return text[1:] if first and first[2] == 0 and first[0].startswith(SPACE) else text

    def remembered(self, chunk: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded text) of a chunk that no piece crosses."""
        if (known := self.known.get(chunk)) is None:
            ids = self.chunk_ids(chunk)
            known = ",".join(map(str, ids)), len(ids), self.decode_pieces(ids)
            if len(chunk) <= LONGEST_REMEMBERED:
                if len(self.known) > MEMORY:
                    self.known.clear()
                self.known[chunk] = known
        return known

    def round_trip(self, text: str) -> tuple[str, int, str]:
        """Joined ids, their number and the text decoded from them."""
        parts = [self.remembered(c) for c in self.chunks(text)]
        if not parts:
            return "", 0, ""
        whole = "".join([p[2] for p in parts])
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), whole[1:]


_last: list = [None, None]


def _codec(shared) -> PieceCodec:
    """The codec of this worker, made anew when it gets another vocabulary."""
    if _last[0] is not shared.value:
        _last[:] = shared.value, PieceCodec(shared.value)
    return _last[1]


class SentencePieces:
    """Columns over whole texts: ids, decoded text, digests. Null texts count as empty and have no ids."""

    def __init__(self, df_or_spark, model_path: str):
        spark = getattr(df_or_spark, "sparkSession", df_or_spark)
        self._vocabulary = spark.sparkContext.broadcast(read_vocabulary(model_path))

    def encode(self, text: Column) -> Column:
        shared = self._vocabulary

        def run(column: pa.Array) -> pa.Array:
            codec = _codec(shared)
            return pa.array([codec.encode(t or "") for t in column.to_pylist()], pa.list_(pa.int32()))

        return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)

    def decode(self, ids: Column) -> Column:
        shared = self._vocabulary

        def run(column: pa.Array) -> pa.Array:
            codec = _codec(shared)
            return pa.array([codec.decode(i or []) for i in column.to_pylist()], pa.string())

        return F.arrow_udf(run, T.StringType())(ids)

    def digest(self, text: Column) -> Column:
        """Struct of n_tokens, ids_sha256 and decoded_sha256; each text is encoded and its ids decoded once."""
        shared = self._vocabulary
        kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

        def run(column: pa.Array) -> pa.Array:
            codec = _codec(shared)
            n, ids, decoded = [], [], []
            for i in range(len(column)):
                joined, count, text = codec.round_trip(column[i].as_py() or "")
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

        return F.arrow_udf(run, kind)(text)


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of every whole text in `out_col` (a clashing column is replaced)."""
    return docs.withColumn(out_col, SentencePieces(docs, model_path).encode(F.col(text_col)))
