"""Document quality from a linear-chain conditional random field over lines.

Every line is described by a few counts over its bytes and words; the features of a
line are its own, those of the line before and those of the line after.  A chain with the
two states good and bad is trained by gradient ascent on the conditional likelihood.
Labels are known for documents only, so each line of a training document has the
label of its document and documents weigh the same whatever their length.  For a text, the
forward-backward marginals of its lines, weighted by their length, are its share of good
text; a logistic curve fitted to the training documents turns it into a probability.

Training takes whole texts of at most ``TRAIN_DOCS`` labelled rows, in the order of a hash of
their id, as long as they have at most ``TRAIN_LINES`` lines together; a text of more than
``TRAIN_LINES / 50`` lines is not learned from.  Their features (float32), not texts, go to the driver.
Chains are whole, however long: parts of ``PART`` lines are computed side by side and pass
their messages on, which gives the gradient of the uncut chain.  Scoring reads whole texts
where they lie and shuffles nothing.

Labels, language, source and id are no input of a score.

Defined cases: a text without a word (null, empty, blank lines) gets the share of good
labels in training; with no labels at all every score is 0.5; several labels of one id count as the lowest,
of several texts of one id the one with the fewest lines is learned from; null labels are ignored; a null id is not held out; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import map_arrow, pick
from pathweave.llm.textscan import SPACED, Words, chunks

TRAIN_DOCS = 4000
TRAIN_LINES = 200_000        # of all texts that are learned from
PART = 32
STEPS = 300
THRESHOLD = 0.3
RIDGE = 1e-3


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


_CLASSES = [
    _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _bytes("abcdefghijklmnopqrstuvwxyz"),
    _bytes("0123456789"),
    _bytes("#*$%&"),
    _bytes("|<>{}[]\\/=_~^@"),
    _bytes("!?"),
    _bytes(".,;:"),
]
N_FEATURES = len(_CLASSES) + 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, its features, its bytes in words) of the lines that have a word."""
    joined = b"\n".join(texts)
    words = Words(texts, SPACED)
    buf = np.frombuffer(joined, np.uint8)
    breaks = np.flatnonzero(buf == 10)
    starts, ends = np.append(0, breaks + 1), np.append(breaks, len(buf))
    line_of = np.searchsorted(breaks, words.abs_starts)            # line of each word
    n_words = np.bincount(line_of, minlength=len(starts))
    kept = np.flatnonzero(n_words)
    n = n_words[kept].astype(float)

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[ends[kept]] - sums[starts[kept]]).astype(float)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(line_of, weights=values, minlength=len(starts))[kept]

    high = np.append((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E), False) if len(buf) else buf == 0
    size = (words.abs_ends - words.abs_starts).astype(float)
    chars = per_word(size)
    h = words.hash

    def again(lag: int) -> np.ndarray:
        same = np.zeros(len(h))
        if len(h) > lag:
            same[lag:] = (h[lag:] == h[:-lag]) & (line_of[lag:] == line_of[:-lag])
        return per_word(same) / n

    counts = [per_line(c[buf]) / chars for c in _CLASSES]
    counts[0] = counts[0] + per_line(high) / chars
    doc = np.searchsorted(words.base, starts[kept], "right") - 1
    first = np.append(True, doc[1:] != doc[:-1])[:len(doc)]
    rows = np.column_stack([*counts, per_line(buf >= 0x80) / chars, chars / n / 10, np.log1p(n) / 5, per_word((size <= 2) * 1.0) / n,
                            again(1), again(2), first * 1.0])
    return doc, rows, chars


def with_neighbours(doc: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and of the next line of the same text (0 if none), and 1."""
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    if len(doc) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:] = rows[:-1] * same
        after[:-1] = rows[1:] * same
    return np.column_stack([rows, before, after, np.ones(len(rows))])


def _softplus(a: float) -> float:
    return a + math.log1p(math.exp(-a)) if a > 0 else math.log1p(math.exp(a))


@dataclass
class Chain:
    """Trained weights; plain numbers, so that they are sent to the tasks as they are."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    trans: list[list[float]]       # [state before][state]
    slope: float
    shift: float
    prior: float

    def emissions(self, doc: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log-odds of good for each line by its features alone."""
        return with_neighbours(doc, (rows - self.mean) / self.scale) @ np.asarray(self.weights)

    def marginals(self, odds: list[float]) -> list[float]:
        """P(good) of each line of one text by forward-backward in log-odds."""
        (t00, t01), (t10, t11) = self.trans

        def step(a: float, to1: tuple[float, float], to0: tuple[float, float]) -> float:
            """log of (e^(a + to1[1]) + e^to1[0]) / (e^(a + to0[1]) + e^to0[0])."""
            return (to1[0] + _softplus(a + to1[1] - to1[0])) - (to0[0] + _softplus(a + to0[1] - to0[0]))

        ahead, a = [], None
        for e in odds:
            a = e if a is None else e + step(a, (t01, t11), (t00, t10))
            ahead.append(a)
        out, b = [0.0] * len(odds), 0.0
        for i in range(len(odds) - 1, -1, -1):
            x = max(-500.0, min(500.0, ahead[i] + b))
            out[i] = 1 / (1 + math.exp(-x))
            b = step(b + odds[i], (t10, t11), (t00, t01))
        return out

    def score(self, share: float | None) -> float:
        if share is None:
            return self.prior
        share = min(1 - 1e-9, max(1e-9, share))
        x = self.slope * math.log(share / (1 - share)) + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    def shares(self, texts: list[bytes]) -> list[float | None]:
        """Length-weighted mean marginal of each text; None without a word."""
        doc, rows, size = line_features(texts)
        return self.shares_of(doc, rows, size, len(texts))

    def shares_of(self, doc: np.ndarray, rows: np.ndarray, size: np.ndarray, n: int) -> list[float | None]:
        out: list[float | None] = [None] * n
        if len(doc):
            odds, length = self.emissions(doc, rows).tolist(), size.tolist()
            edges = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
            for a, b in zip(edges, edges[1:], strict=False):
                p = self.marginals(odds[a:b])
                out[int(doc[a])] = math.fsum(x * w for x, w in zip(p, length[a:b], strict=True)) / math.fsum(length[a:b])
        return out


@dataclass
class Parts:
    """Padded parts of chains; the parts of one chain stand one after another."""

    x: np.ndarray                  # (n, T, d)
    y: np.ndarray                  # (n, T), 0 and 1
    live: np.ndarray               # (n, T), False where padded
    weight: np.ndarray             # (n,), 1 / lines of the chain: documents weigh the same
    place: np.ndarray              # (n,), 0 for the first part of a chain

    @staticmethod
    def of(chains: list[tuple[int, np.ndarray]]) -> Parts:
        """Chains (label, features of each line) cut into parts of ``PART`` lines."""
        cut = [(y, f[i:i + PART], 1 / len(f), i // PART) for y, f in chains for i in range(0, len(f), PART)]
        steps = max(len(f) for _, f, _, _ in cut)
        x, live = np.zeros((len(cut), steps, cut[0][1].shape[1])), np.zeros((len(cut), steps), bool)
        for k, (_, f, _, _) in enumerate(cut):
            x[k, :len(f)], live[k, :len(f)] = f, True
        y = np.array([[c[0]] for c in cut], float) * live
        return Parts(x, y, live, np.array([c[2] for c in cut]), np.array([c[3] for c in cut]))


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(*np.moveaxis(a, axis, 0))


def _forward(e: np.ndarray, live: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log sums over the paths to each line and state; ``e`` (n, T, 2), ``start`` (n, ..., 2) as they enter the first line."""
    wide = (slice(None),) + (None,) * (start.ndim - 2)
    out = [start + e[:, 0][wide]]
    for i in range(1, e.shape[1]):
        ahead = e[:, i][wide] + _lse(out[-1][..., None] + t, -2)
        out.append(np.where(live[:, i][wide + (None,)], ahead, out[-1]))
    return np.stack(out, 1)


def _messages(e: np.ndarray, parts: Parts, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What enters each part from the left, from the right, and what its first line hands to the left."""
    n = len(e)
    left, right, head = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    if not parts.place.any():
        return left, right, head
    start = np.broadcast_to(np.array([[0.0, -np.inf], [-np.inf, 0.0]]), (n, 2, 2))
    over = _forward(e, parts.live, t, start)[:, -1]                # (part, state at its first line, state at its last)
    levels = [np.flatnonzero(parts.place == k) for k in range(parts.place.max() + 1)]
    for at in levels[1:]:
        v = _lse(left[at - 1][:, :, None] + over[at - 1], 1)
        left[at] = _lse((v - v.max(1, keepdims=True))[:, :, None] + t, 1)
    for at in reversed(levels[1:]):
        v = _lse(over[at] + right[at][:, None, :], 2)
        head[at] = v - v.max(1, keepdims=True)
        right[at - 1] = _lse(t + head[at][:, None, :], 2)
    return left, right, head


def _chain_gradient(parts: Parts, w, t):
    """Gradient of the log-likelihood per line, summed over whole chains."""
    x, y, live = parts.x, parts.y, parts.live
    steps = x.shape[1]
    e = np.stack([np.zeros(y.shape), x @ w], -1)
    left, right, head = _messages(e, parts, t)
    a = _forward(e, live, t, left)
    b = np.empty_like(a)
    b[:, -1] = right
    for i in range(steps - 2, -1, -1):
        b[:, i] = np.where(live[:, i + 1, None], _lse(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), b[:, i + 1])
    z = _lse(a[:, -1] + right, 1)
    weight = live * parts.weight[:, None]
    p1 = np.exp(a[..., 1] + b[..., 1] - z[:, None])
    gw = np.einsum("nt,ntd->d", (y - p1) * weight, x)
    pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
    seen = np.stack([1 - y, y], -1)
    gt = ((seen[:, :-1, :, None] * seen[:, 1:, None, :] - pair) * weight[:, 1:, None, None]).sum((0, 1))
    at = np.flatnonzero(parts.place)                               # pairs of lines that stand in two parts
    if len(at):
        across = a[at - 1, -1][:, :, None] + t + head[at][:, None, :]
        across = np.exp(across - _lse(_lse(across, 2), 1)[:, None, None])
        first = seen[at, 0]                                        # a text has one label, so both lines have it
        gt = gt + ((first[:, :, None] * first[:, None, :] - across) * parts.weight[at, None, None]).sum(0)
    return gw, gt


def _blocks(chains: list[tuple[int, np.ndarray]]) -> list[Parts]:
    """Chains of like length together, about 1,024 parts a block; a chain is never split over blocks."""
    blocks, some, parts = [], [], 0
    for c in sorted(chains, key=lambda c: len(c[1])):
        if some and (parts + -(-len(c[1]) // PART) > 1024 or (len(c[1]) > PART) != (len(some[0][1]) > PART)):
            blocks.append(Parts.of(some))
            some, parts = [], 0
        some.append(c)
        parts += -(-len(c[1]) // PART)
    return [*blocks, Parts.of(some)] if some else blocks


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Chain:
    """``rows``: (label, features line after line, bytes of each line) of the training documents, whole texts."""
    rows = [(y, np.asarray(f, float).reshape(-1, N_FEATURES), np.asarray(s, float)) for y, f, s in rows]
    prior = float(np.mean([y for y, _, _ in rows])) if rows else 0.5
    d = 3 * N_FEATURES + 1
    used = [r for r in rows if len(r[1])]
    if not used or len({y for y, _, _ in used}) < 2:
        return Chain([0.0] * N_FEATURES, [1.0] * N_FEATURES, [0.0] * d, [[0.0] * 2] * 2, 0.0,
                     math.log((prior + 1e-6) / (1 - prior + 1e-6)), prior)
    lines = np.concatenate([f for _, f, _ in used])
    mean, scale = lines.mean(0), lines.std(0) + 1e-6
    blocks = _blocks([(y, with_neighbours(np.zeros(len(f)), (f - mean) / scale)) for y, f, _ in used])
    w, t = np.zeros(d), np.zeros((2, 2))
    moments = [np.zeros(d), np.zeros(d), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):                               # Adam, full batch
        found = [_chain_gradient(b, w, t) for b in blocks]
        gw = sum(g for g, _ in found) / len(used) - RIDGE * w
        gt = sum(g for _, g in found) / len(used) - RIDGE * t
        for k, (g, v) in enumerate(((gw, w), (gt, t))):
            m1, m2 = moments[2 * k], moments[2 * k + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    chain = Chain(mean.tolist(), scale.tolist(), w.tolist(), t.tolist(), 1.0, 0.0, prior)
    share = np.array([chain.shares_of(np.zeros(len(f), int), f, s, 1)[0] for _, f, s in used])
    share = np.clip(share, 1e-9, 1 - 1e-9)
    u, label = np.log(share / (1 - share)), np.array([y for y, _, _ in used], float)
    a, b = 1.0, 0.0                                                # logistic curve, by Newton steps with a small ridge
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -500, 500)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((label - p) * u).sum() - 1e-2 * (a - 1), (label - p).sum() - 1e-2 * b])
        h = np.array([[(v * u * u).sum() + 1e-2, (v * u).sum()], [(v * u).sum(), v.sum() + 1e-2]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + da, b + db
    chain.slope, chain.shift = float(max(a, 1e-3)), float(b)
    return chain


def _describe(batches):
    """Training rows -> the features of all their lines, as float32."""
    import pyarrow as pa

    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        described = [line_features([t])[1:] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([d[i].astype(np.float32).tobytes() for d in described], pa.binary()) for i in (0, 1))],
            names=["label", "features", "sizes"])


def held_out(doc_id) -> F.Column:
    """Whether a row may not be learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _learned(docs: DataFrame, labels: DataFrame, train_docs: int, train_lines: int) -> DataFrame:
    """(label, text) of the rows that are learned from."""
    known = (pick(labels, doc_id="bigint", quality="int").dropna().filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("label")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.orderBy(*order).limit(train_docs)
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    texts = pick(docs, doc_id="bigint", text="string").withColumn("one", F.struct(lines.alias("lines"), F.xxhash64("text").alias("h")))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("one").alias("one"))
    before = F.sum("one.lines").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))   # at most train_docs rows
    used = sizes.filter(F.col("one.lines") <= train_lines / 50).withColumn("total", before).filter(F.col("total") <= train_lines)
    return (texts.join(F.broadcast(used.select("doc_id", "one", "label")), ["doc_id", "one"])
            .dropDuplicates(["doc_id"]).select("label", "text"))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Chain:
    rows = map_arrow(_learned(docs, labels, train_docs, train_lines), _describe, "label int, features binary, sizes binary").collect()
    return train([(r[0], np.frombuffer(r[1], np.float32), np.frombuffer(r[2], np.float32))
                  for r in sorted((int(r[0]), bytes(r[1]), bytes(r[2])) for r in rows)])


def _scorer(model) -> Callable:
    def score(batches):
        import pyarrow as pa

        chain = Chain(**model.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            out = []
            for lo, hi in chunks(texts):
                out += [chain.score(s) for s in chain.shares(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    chain = fit(docs, labels, train_docs)
    model = docs.sparkSession.sparkContext.broadcast(vars(chain))            # a few hundred numbers
    scored = map_arrow(pick(docs, doc_id="bigint", text="string"), _scorer(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
