"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a hashed word vector and the mean of its hashed character n-gram
vectors, so unseen spellings share what their parts have learned. Windows of ``WINDOW`` words
that overlap by a quarter run through the network in both directions; attention pools a
window's states to one score. All windows of a text are scored, the highest is the text's score.

Training takes a bounded sample of labelled rows (``max_rows``) on the driver: each step scores
all windows of some texts and follows the gradient of every text's highest one. Scoring is one
pass over the texts in Arrow batches without a shuffle; windows of many texts run through the
network together, and a worker remembers the input projections of words it has seen.
"""

from __future__ import annotations

import functools
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripletspark.llm.tables import texts

WINDOW, STRIDE = 48, 36
HIDDEN, INPUT = 8, 16
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 13
GRAMS = (3, 4, 5)
THRESHOLD = 0.7
#: Share of words that a training step leaves out, against learning single texts by heart.
DROPPED = 0.05
_TOKEN = re.compile(r"\w+")


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash rows of the words' character n-grams, their borders marked, word after word; and how
    many each word has (at least one)."""
    marked = [f"<{w}>".encode() if w else b"<>>" for w in words]
    sizes = np.array([len(m) for m in marked])
    buf = np.frombuffer(b"".join(marked) + bytes(max(GRAMS)), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), sizes)
    at, ends = np.arange(len(word)), np.cumsum(sizes)[word]
    rows, owner = [], []
    for n in GRAMS:
        h = np.full(len(word), n, np.uint32)
        for j in range(n):
            h = (h ^ buf[j:j + len(word)]) * np.uint32(0x01000193)
        whole = at + n <= ends
        rows.append((h ^ h >> np.uint32(15))[whole] % np.uint32(CHAR_ROWS))
        owner.append(word[whole])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(rows)[order].astype(np.int64),
            np.bincount(owner, minlength=len(words)))


def word_rows(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64) % WORD_ROWS


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return rng.normal(0, shape[-2] ** -0.5 if len(shape) > 1 else 1, shape).astype(np.float32)
    h = HIDDEN
    out = {"word": normal(WORD_ROWS, INPUT) * np.float32(np.sqrt(WORD_ROWS) * 0.02),
           "char": normal(CHAR_ROWS, INPUT) * np.float32(np.sqrt(CHAR_ROWS) * 0.05),
           "att": normal(2 * h, 1)[:, 0], "out": normal(2 * h, 1)[:, 0],
           "bias": np.array([-2.0], np.float32)}
    for d in ("f", "b"):  # input, recurrent and bias weights of the update, reset, new gates
        out |= {f"w{d}": normal(INPUT, 3 * h), f"u{d}": normal(h, 3 * h),
                f"c{d}": np.zeros(3 * h, np.float32)}
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def recur(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of a gated recurrent layer. x: (steps, windows, 3 * hidden), inputs projected."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states = np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)):
        gates = sigmoid(x[t, :, :2 * HIDDEN] + h @ u[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[t, :, 2 * HIDDEN:] + (r * h) @ u[:, 2 * HIDDEN:])
        if keep is not None:
            keep.append((h, z, r, new))
        h = h + z * (new - h)
        states[t] = h
    return states


def recur_back(grad: np.ndarray, keep: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    dx = np.empty((*grad.shape[:2], 3 * HIDDEN), np.float32)
    du, dh = np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
    for t in range(len(grad) - 1, -1, -1):
        h, z, r, new = keep[t]
        dh = dh + grad[t]
        dnew = dh * z * (1 - new * new)
        dz = dh * (new - h) * z * (1 - z)
        drh = dnew @ u[:, 2 * HIDDEN:].T
        dr = drh * h * r * (1 - r)
        gates = np.concatenate([dz, dr], 1)
        dx[t, :, :2 * HIDDEN], dx[t, :, 2 * HIDDEN:] = gates, dnew
        du[:, :2 * HIDDEN] += h.T @ gates
        du[:, 2 * HIDDEN:] += (r * h).T @ dnew
        dh = dh * (1 - z) + drh * r + gates @ u[:, :2 * HIDDEN].T
    return dx, du


def pool(states: np.ndarray, mask: np.ndarray, p: dict
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the windows, their attention and pooled states. mask: (steps, windows)."""
    scores = np.where(mask, states @ p["att"], -1e9)
    att = np.exp(scores - scores.max(0))
    att /= att.sum(0)
    pooled = np.einsum("tw,twh->wh", att, states)
    return pooled @ p["out"] + p["bias"], att, pooled


def window_starts(n: int) -> range:
    """Starts of the windows of n words: every word is in one, the last may be short."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


class Inputs:
    """Words as numbers; a row of both directions' projected inputs for each number."""

    def __init__(self, p: dict, limit: int = 500_000):
        self.p, self.limit = p, limit
        self.w = np.concatenate([p["wf"], p["wb"]], 1)
        self.c = np.concatenate([p["cf"], p["cb"]])
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.empty((1 << 12, 6 * HIDDEN), np.float32)

    def vectors(self, words: list[str]) -> np.ndarray:
        """Input vectors of words: own row plus the mean of their n-grams' rows."""
        rows, sizes = gram_rows(words)
        mean = np.add.reduceat(self.p["char"][rows], np.r_[0, np.cumsum(sizes)[:-1]], 0)
        return self.p["word"][word_rows(words)] + mean / sizes[:, None].astype(np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.limit:
            self.reset()
        known = self.number
        new = list(set(words).difference(known))
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            rows = self.vectors(part) @ self.w + self.c
            at = len(known)
            while at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[at:at + len(part)] = rows
            known.update(zip(part, range(at, at + len(part)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def window_logits(p: dict, inputs: Inputs, docs: list[list[str]], block: int = 1024
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and logit of every window of some texts' words (one at least a text). Windows
    of all texts run in blocks of bounded size."""
    numbers = inputs.numbers([w for d in docs for w in d])
    lengths = np.array([len(d) for d in docs])
    first = np.cumsum(lengths) - lengths
    starts = [np.array(window_starts(n)) for n in lengths]
    owner = np.repeat(np.arange(len(docs)), [len(x) for x in starts])
    start = np.concatenate(starts)
    sizes = np.minimum(WINDOW, lengths[owner] - start)
    out = np.empty(len(owner), np.float32)
    steps = np.arange(WINDOW)[:, None]
    for i in range(0, len(owner), block):
        size, cols = sizes[i:i + block], np.arange(len(sizes[i:i + block]))
        base = (first[owner] + start)[i:i + block]
        mask = steps < size
        x = inputs.table[numbers[np.where(mask, base + steps, base)]]
        turn = np.where(mask, size - 1 - steps, steps)  # the words backwards
        forth = recur(x[..., :3 * HIDDEN], p["uf"])
        back = recur(x[turn, cols, 3 * HIDDEN:], p["ub"])[turn, cols]
        out[i:i + block], _, _ = pool(np.concatenate([forth, back], 2), mask, p)
    return owner, start, out


def tokens(text: str) -> list[str]:
    """Lower-cased words; a text without any is one empty word."""
    return _TOKEN.findall(text.lower()) or [""]


def logits(p: dict, inputs: Inputs, docs: list[str]) -> np.ndarray:
    """The highest window logit of each text."""
    best = np.full(len(docs), -np.inf, np.float32)
    owner, _, got = window_logits(p, inputs, [tokens(d) for d in docs])
    np.maximum.at(best, owner, got)
    return best


def _step(p: dict, windows: list[list[str]], y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over some windows, sparse for the embedding rows."""
    n = len(windows)
    size = max(len(w) for w in windows)
    mask = np.zeros((size, n), bool)
    for k, w in enumerate(windows):
        mask[:len(w), k] = True
    sizes = mask.sum(0)
    steps, cols = np.arange(size)[:, None], np.arange(n)
    turn = np.where(steps < sizes, sizes - 1 - steps, steps)
    words = sorted({w for own in windows for w in own})
    number = {w: i for i, w in enumerate(words)}
    flat, counts = gram_rows(words)
    own = word_rows(words)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    e = p["word"][own] + np.add.reduceat(p["char"][flat], starts, 0) / counts[:, None]
    grid = np.zeros((size, n), np.int64)
    for k, w in enumerate(windows):
        grid[:len(w), k] = [number[x] for x in w]
    x = e.astype(np.float32)[grid]
    back_in = x[turn, cols]
    keep_f, keep_b = [], []
    forth = recur(x @ p["wf"] + p["cf"], p["uf"], keep_f)
    back = recur(back_in @ p["wb"] + p["cb"], p["ub"], keep_b)[turn, cols]
    states = np.concatenate([forth, back], 2)
    logit, att, pooled = pool(states, mask, p)
    d = ((sigmoid(logit) - y) / n).astype(np.float32)
    g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    dpool = d[:, None] * p["out"]
    datt = np.einsum("twh,wh->tw", states, dpool)
    dscore = att * (datt - (att * datt).sum(0))
    g["att"] = np.einsum("tw,twh->h", dscore, states)
    ds = att[..., None] * dpool + dscore[..., None] * p["att"]
    dxf, g["uf"] = recur_back(ds[..., :HIDDEN], keep_f, p["uf"])
    dxb, g["ub"] = recur_back(ds[..., HIDDEN:][turn, cols], keep_b, p["ub"])
    dxf, dxb = np.where(mask[..., None], dxf, 0), np.where(mask[..., None], dxb, 0)
    g["wf"], g["cf"] = np.einsum("twi,twk->ik", x, dxf), dxf.sum((0, 1))
    g["wb"], g["cb"] = np.einsum("twi,twk->ik", back_in, dxb), dxb.sum((0, 1))
    dx = dxf @ p["wf"].T + (dxb @ p["wb"].T)[turn, cols]
    de = np.zeros((len(words), INPUT), np.float32)
    np.add.at(de, grid[mask], dx[mask])
    g["word"] = (own, de)
    g["char"] = (flat, np.repeat(de / counts[:, None], counts, 0).astype(np.float32))
    return g


def train(docs: list[str], y: list[int], steps: int = 260, batch: int = 64, rate: float = 0.015,
          seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the highest window of every text, over all texts four times or more often until
    ``steps`` steps are done; texts of one class only give that class."""
    epochs = max(4, -(-steps * batch // len(docs)))
    p = new_weights(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    rng, t = np.random.default_rng(seed), 0
    split = [tokens(d) for d in docs]
    labels = np.array(y, np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            chosen = order[i:i + batch]
            if epoch:
                owner, start, got = window_logits(p, Inputs(p), [split[k] for k in chosen])
                rank = np.lexsort((start, -got, owner))
                top = start[rank[np.flatnonzero(np.r_[True, np.diff(owner[rank]) > 0])]]
            else:
                top = [rng.choice(window_starts(len(split[k]))) for k in chosen]
            own = [[w for w in split[k][s:s + WINDOW] if rng.random() > DROPPED] or [""]
                   for k, s in zip(chosen, top, strict=True)]
            g = _step(p, own, labels[chosen])
            t += 1
            pace = rate * (1 - (epoch * len(order) + i) / (epochs * len(order)))
            for name, grad in g.items():
                if name in ("word", "char"):
                    rows, at = np.unique(grad[0], return_inverse=True)
                    dense = np.zeros((len(rows), INPUT), np.float32)
                    np.add.at(dense, at, grad[1])
                else:
                    rows, dense = slice(None), grad
                m[name][rows] = 0.9 * m[name][rows] + 0.1 * dense
                v[name][rows] = 0.999 * v[name][rows] + 0.001 * dense * dense
                step = pace * (m[name][rows] / (1 - 0.9 ** t)) / (
                    np.sqrt(v[name][rows] / (1 - 0.999 ** t)) + 1e-6)
                p[name][rows] -= step.astype(np.float32)
    return p


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 4000,
                  max_chars: int = 20_000) -> list[tuple[str, int]]:
    """Texts and labels of at most ``max_rows`` labelled doc_ids, half of them toxic where there
    are so many, picked by a hash of the doc_id, none of them held out. Texts over ``max_chars``
    aren't sampled, so the driver holds max_rows * max_chars characters at most.

    The ids are picked from the narrow table of labels; their texts then come from one scan, and
    no text is shuffled but theirs."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                         & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic"))
    ids: list[tuple[int, int]] = []
    for y in (1, 0):
        picked = (known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id")
                  .limit(max_rows // 2 if y else max_rows - len(ids)))
        ids += [(r["doc_id"], y) for r in picked.select("doc_id").collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "id long, toxic int")
    rows = (texts(docs).where(F.length("text") <= max_chars)
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
            .groupBy("id", "toxic").agg(F.min("text").alias("text")))
    return [(r["text"], r["toxic"]) for r in rows.orderBy("id").collect()]


@functools.lru_cache(maxsize=2)
def _loaded(raw: bytes) -> tuple[dict, Inputs]:
    """Weights and word table, kept by a worker from task to task."""
    p = dict(np.load(io.BytesIO(raw)))
    return p, Inputs(p)


def score_texts(docs: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score: of the highest of all overlapping windows. Only the text is an input."""
    raw = io.BytesIO()
    np.savez(raw, **p)
    weights = docs.sparkSession.sparkContext.broadcast(raw.getvalue())  # about 1 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, inputs = _loaded(weights.value)
        for batch in batches:
            column = batch.column("text")
            got = [logits(own, inputs, column[i:i + 200].to_pylist())
                   for i in range(0, len(column), 200)]
            score = sigmoid(np.concatenate(got).astype(np.float64)) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)],
                                             names=["doc_id", "score"])
    return (texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, score double"))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score of at
    least ``THRESHOLD``).

    Trained on labelled rows that aren't held out; a doc_id with several labels counts as toxic
    if one says so. Null and empty texts are scored as an empty word; a null doc_id is not held
    out. Without labels the network stays as it starts, at low scores.
    """
    rows = training_rows(docs, labels, max_rows)
    p = train([t for t, _ in rows], [y for _, y in rows]) if rows else new_weights()
    scored = score_texts(docs, p)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
