"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling.

Words enter as a learned vector (frequent words have their own) next to the
mean vector of their byte n-grams. The network reads windows of words that
overlap by half and cover the whole text; a text's score comes from its worst
window. It is trained in numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.workspace import small_batches
from tidemark.llm.words import mixed, slices

#: Labelled texts of each label from which the network learns, at most; those with the smallest hash of doc_id.
SAMPLE = 1_500
#: Bytes of training texts of each label that are brought to the driver, at most.
SAMPLE_BYTES = 12 << 20
WINDOW, STRIDE = 32, 16
WORDS, WORD_DIM = 2_000, 8
GRAMS, GRAM_DIM = 1 << 15, 8
HIDDEN = 8
#: Windows taken of each sampled text of label 0 in training; of label 1 as many of the most telling ones.
WINDOWS = 12


def _inputs(text):
    """Words of a slice by kind: hash, row, index of its kind; kinds' hashes; n-gram ids and where each kind's begin."""
    start, end, row = text.words()
    h = text.hashes(start, end, fold=True)
    kinds, first, of = np.unique(h, return_index=True, return_inverse=True)
    b = text.bytes.astype(np.uint64)
    b[(b >= 65) & (b <= 90)] += np.uint64(32)
    size = end[first] - start[first]
    # 4-grams of the word between two edge marks, at least one
    many = np.maximum(size - 1, 1)
    begins = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(start[first] - 1 - begins[:-1], many) + np.arange(begins[-1])
    lo, hi = np.repeat(start[first], many), np.repeat(end[first], many)
    gram = np.zeros(len(at), np.uint64)
    for k in range(4):
        p = at + k
        inside = (p >= lo) & (p < hi)
        gram = (gram << np.uint64(8)) | np.where(inside, b[np.clip(p, 0, len(b) - 1)] if len(b) else 0, np.uint64(1))
    ids = (mixed(gram) >> np.uint64(49)).astype(np.int64)
    return row, of, kinds, ids, begins


def _windows(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each window, and its row; rows without words have none."""
    first = np.searchsorted(row, np.arange(n))
    words = np.bincount(row, minlength=n)[:n]
    many = np.where(words > 0, np.maximum(1, -(-(words - WINDOW) // STRIDE) + 1), 0)
    of = np.repeat(np.arange(n), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    begin = first[of] + k * STRIDE
    return begin, np.minimum(WINDOW, first[of] + words[of] - begin), of


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and passes of the network; everything is float32."""

    SHAPES = {
        "word": (WORDS + 1, WORD_DIM),
        "gram": (GRAMS, GRAM_DIM),
        **{f"w{d}": (WORD_DIM + GRAM_DIM, 3 * HIDDEN) for d in "fb"},
        **{f"u{d}": (HIDDEN, 3 * HIDDEN) for d in "fb"},
        **{f"c{d}": (3 * HIDDEN,) for d in "fb"},
        "att": (2 * HIDDEN, HIDDEN),
        "query": (HIDDEN,),
        "out": (2 * HIDDEN,),
        "bias": (1,),
    }

    def __init__(self, words: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.words = words
        scale = {"word": 0.1, "gram": 0.3, "bias": 0, "cf": 0, "cb": 0}
        self.p = {k: (rng.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in self.SHAPES.items()}
        self.calibration = np.array([1.0, 0.0, 0.0])

    def word_ids(self, kinds: np.ndarray) -> np.ndarray:
        if len(self.words) == 0:
            return np.full(len(kinds), WORDS)
        at = np.minimum(np.searchsorted(self.words, kinds), len(self.words) - 1)
        return np.where(self.words[at] == kinds, at, WORDS)

    def vectors(self, kinds, ids, begins) -> np.ndarray:
        """Input of each kind of word."""
        mean = np.add.reduceat(self.p["gram"][ids], begins[:-1], axis=0) / np.diff(begins)[:, None].astype(np.float32)
        return np.hstack([self.p["word"][self.word_ids(kinds)], mean])

    def _gates(self, d, a, h):
        u = self.p["u" + d]
        zr = _sigmoid(a[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
        return z, r, c

    def forward(self, projected: dict, index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window. projected: input times weights by direction and kind; index: kinds in each window."""
        n, steps = index.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        trace = {}
        for d, order, cols in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, None))):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                z, r, c = self._gates(d, projected[d][index[:, t]], h)
                there = (t < length)[:, None]
                new = np.where(there, h + z * (c - h), h)
                if keep:
                    trace[d, t] = (h, z, r, c, there)
                h = new
                states[t, :, cols] = h
        k = np.tanh(states @ self.p["att"])
        e = k @ self.p["query"]
        e[np.arange(steps)[:, None] >= length[None, :]] = -1e9
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, states, trace, k, a, pooled) if keep else logit

    def gradients(self, kinds, ids, begins, index, length, label):
        """Gradients of the mean log loss of some windows, by back-propagation through time."""
        p = self.p
        x = self.vectors(kinds, ids, begins)
        projected = {d: x @ p["w" + d] + p["c" + d] for d in "fb"}
        logit, states, trace, k, a, pooled = self.forward(projected, index, length, keep=True)
        n, steps = index.shape
        dlogit = ((_sigmoid(logit) - label) / n).astype(np.float32)
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["out"]
        da = (states * dpooled[None]).sum(axis=2)
        ds = a[:, :, None] * dpooled[None]
        de = a * (da - (a * da).sum(axis=0))
        g["query"] = np.einsum("tn,tnh->h", de, k)
        dk = de[:, :, None] * p["query"] * (1 - k * k)
        g["att"] = np.einsum("tni,tnh->ih", states, dk)
        ds += dk @ p["att"].T
        dproj = {}
        flat = index.T.ravel()
        by_kind = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by_kind], np.arange(len(kinds)))
        for d, order, cols in (("f", range(steps - 1, -1, -1), slice(0, HIDDEN)), ("b", range(steps), slice(HIDDEN, None))):
            u = p["u" + d]
            du, dp = np.zeros_like(u), np.zeros((steps, n, 3 * HIDDEN), np.float32)
            carry = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                h, z, r, c, there = trace[d, t]
                total = carry + ds[t, :, cols]
                live = np.where(there, total, 0)
                dc = live * z * (1 - c * c)
                dz = live * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                dzr = np.hstack([dz, dr])
                carry = np.where(there, live * (1 - z), total) + drh * r + dzr @ u[:, : 2 * HIDDEN].T
                du[:, : 2 * HIDDEN] += h.T @ dzr
                du[:, 2 * HIDDEN :] += (r * h).T @ dc
                dp[t, :, : 2 * HIDDEN], dp[t, :, 2 * HIDDEN :] = dzr, dc
            # every kind occurs in the windows, so no run is empty
            g["u" + d], dproj[d] = du, np.add.reduceat(dp.reshape(-1, 3 * HIDDEN)[by_kind], edges, axis=0)
        dx = 0
        for d in "fb":
            g["w" + d], g["c" + d] = x.T @ dproj[d], dproj[d].sum(axis=0)
            dx = dx + dproj[d] @ p["w" + d].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], self.word_ids(kinds), dx[:, :WORD_DIM])
        g["gram"] = np.zeros_like(p["gram"])
        np.add.at(g["gram"], ids, np.repeat(dx[:, WORD_DIM:] / np.diff(begins)[:, None], np.diff(begins), axis=0))
        return g, logit

    def worst_windows(self, text) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit among the windows of each text, and their number; all windows are read."""
        row, of, kinds, ids, begins = _inputs(text)
        worst = np.full(text.n, -20.0)
        many = np.zeros(text.n)
        if len(row) == 0:
            return worst, many
        begin, length, owner = _windows(row, text.n)
        x = self.vectors(kinds, ids, begins)
        projected = {d: x @ self.p["w" + d] + self.p["c" + d] for d in "fb"}
        index = of[np.minimum(begin[:, None] + np.arange(WINDOW), len(of) - 1)]
        np.maximum.at(worst, owner, self.forward(projected, index, length).astype(float))
        return worst, np.bincount(owner, minlength=text.n).astype(float)

    def probability(self, text) -> np.ndarray:
        worst, many = self.worst_windows(text)
        a, b, c = self.calibration
        return _sigmoid(np.clip(a * worst + b * np.log1p(many) + c, -30, 30))


def _leaning(yes: np.ndarray, no: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How much each kind leans towards label 1: log odds of the texts that hold it, drawn towards 0 for few texts."""
    a, b = max((label > 0).sum(), 1), max((label == 0).sum(), 1)
    return (np.log((yes + 0.5) / (a + 1)) - np.log((no + 0.5) / (b + 1))) * yes / (yes + 2)


def _calibrated(x: np.ndarray, label: np.ndarray, drawn: float = 1.0) -> np.ndarray:
    """Logistic weights, drawn towards (1, 0, 0), by Newton steps that never raise the loss."""
    start = w = np.array([1.0, 0.0, 0.0])

    def loss(v):
        m = np.clip(x @ v, -500, 500)
        return (np.logaddexp(0, m) - label * m).sum() + drawn / 2 * ((v - start) ** 2).sum()

    for _ in range(40):
        q = _sigmoid(np.clip(x @ w, -500, 500))
        slope = x.T @ (q - label) + drawn * (w - start)
        move = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + drawn * np.eye(3), slope)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * move) > loss(w):
            scale /= 2
        if scale <= 1e-4:
            break
        w = w - scale * move
    return w if w[0] > 0 else start


def train(texts: list[str], label: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
    """Fits a network to labelled texts with Adam.

    A toxic text doesn't say which of its windows is toxic: to begin with, the
    windows that hold the words which lean most towards toxic texts stand for it.
    """
    rng = np.random.default_rng(seed)
    part = list(slices(pa.array(texts, pa.large_string()), 1 << 62))
    if not part or len(set(label.tolist())) < 2:
        net = Network(np.zeros(0, np.uint64))
        net.p["out"][:] = 0
        share = float(label.mean()) if len(label) else 0.0
        net.calibration = np.array([0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))])
        return net
    text = part[0]
    row, of, kinds, ids, begins = _inputs(text)
    # texts that hold each word and each n-gram, by label, some texts at a time
    spans = np.diff(begins)
    held, gram_held = np.zeros((2, len(kinds)), np.int64), np.zeros((2, GRAMS), np.int64)
    cut = np.searchsorted(row, np.arange(text.n + 1))
    for i in range(text.n):
        mine = np.unique(of[cut[i] : cut[i + 1]])
        span = spans[mine]
        at = np.repeat(begins[mine] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        held[int(label[i] > 0), mine] += 1
        gram_held[int(label[i] > 0), np.unique(ids[at])] += 1
    net = Network(kinds[np.sort(np.argsort(-held.sum(axis=0), kind="stable")[:WORDS])])
    # a word leans as much as the one of its n-grams that leans most
    lean, gram_lean = _leaning(held[1], held[0], label), _leaning(gram_held[1], gram_held[0], label)
    strength = np.maximum(lean, np.maximum.reduceat(gram_lean[ids], begins[:-1]))[of].astype(np.float32)
    begin, length, owner = _windows(row, text.n)
    inside = np.minimum(begin[:, None] + np.arange(WINDOW), len(of) - 1)
    real = np.arange(WINDOW) < length[:, None]
    telling = np.where(real, strength[inside], -9).max(axis=1)
    index = of[inside].astype(np.int32)
    del inside, real
    best = np.full(text.n, -9.0)
    np.maximum.at(best, owner, telling)
    toxic = label[owner] > 0
    yes = np.flatnonzero(toxic & (telling >= np.maximum(best[owner] - 0.7, 1.0)))
    no = np.flatnonzero(~toxic)
    if len(yes) == 0:
        yes = np.flatnonzero(toxic)
    no = hard = rng.permutation(no)[: WINDOWS * max(int((label == 0).sum()), 1)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        if step % 150 == 0:
            # from here on half of the clean windows are those that look worst
            x = net.vectors(kinds, ids, begins)
            projected = {d: x @ net.p["w" + d] + net.p["c" + d] for d in "fb"}
            logit = np.concatenate([net.forward(projected, index[k], length[k]) for k in np.array_split(no, len(no) // 4096 + 1)])
            hard = no[np.argsort(-logit, kind="stable")[: max(64, len(no) // 50)]]
        n = batch // 3
        pick = np.concatenate([rng.choice(yes, n), rng.choice(no, n), rng.choice(hard, batch - 2 * n)])
        some, local = np.unique(index[pick], return_inverse=True)
        local = local.reshape(len(pick), WINDOW)
        sub = np.concatenate([[0], np.cumsum(spans[some])])
        at = np.repeat(begins[some] - sub[:-1], spans[some]) + np.arange(sub[-1])
        # now and then a word counts as unknown, so that its n-grams must tell
        shown = np.where(rng.random(len(some)) < 0.5, np.uint64(0), kinds[some])
        g, _ = net.gradients(shown, ids[at], sub, local, length[pick], np.repeat([1.0, 0.0], [n, batch - n]))
        lr = rate * (1 - step / (steps + 1))
        for k, v in g.items():
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            net.p[k] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    # scores of whole texts as probabilities
    found = [net.worst_windows(t) for t in slices(pa.array(texts, pa.large_string()))]
    worst, many = (np.concatenate(x) for x in zip(*found, strict=True))
    net.calibration = _calibrated(np.column_stack([worst, np.log1p(many), np.ones(len(worst))]), label)
    return net


def fit_network(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Trains on at most `sample` texts and SAMPLE_BYTES bytes of each label whose crc32(doc_id) mod 5 is not 0.

    Rows without label or text teach nothing; of a text's labels the highest
    counts, and of equal texts one. With one label only, all texts get its share as score.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    small_batches(docs.sparkSession)
    some = lambda is_toxic: known.filter((F.col("label") > 0) == is_toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = some(True).unionByName(some(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(known), "doc_id")
    # sizes of these few thousand texts first, the smallest of rows that repeat a doc_id; then, in order of hash, as many texts as fit
    sizes = rows.select("doc_id", "label", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("own")).filter(F.col("bytes") <= SAMPLE_BYTES)
    sizes = sizes.groupBy("doc_id", "label").agg(F.min(F.struct("bytes", "own")).alias("v")).select("doc_id", "label", "v.*")
    so_far = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "own")
    rows = rows.withColumn("own", F.xxhash64("text")).join(F.broadcast(some), ["doc_id", "own"])
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    one = {xxhash.xxh3_128_intdigest(r.text.encode("utf-8")): r for r in sorted(rows, key=lambda r: (r.label, -r.doc_id))}
    rows = sorted(one.values(), key=lambda r: r.doc_id)
    return train([r.text for r in rows], np.array([float(r.label) for r in rows]))


def toxicity_of(docs: DataFrame, network: Network, text: Column) -> Column:
    """Probability of label 1 for each whole text; null and empty texts are scored as texts without windows."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(column: pa.Array) -> pa.Array:
        parts = [shared.value.probability(t) for t in slices(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(run, T.DoubleType())(text)
