"""Language of whole texts: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Letters and marks are kept in lower case, anything else is one space.  Character n-grams of
   ``ORDERS`` that hold no space but at their ends are hashed to ``2**BITS`` columns.
2. Document frequencies are counted over all learning rows: each task adds up one vector, the
   vectors are summed by Spark, and one number for each column comes to the driver.
3. The model learns from a bounded sample of distinct labelled texts: at most ``TRAIN_DOCS`` texts
   and ``TRAIN_CHARS`` characters, shared equally by the languages; whole texts, chosen by their
   checksum.  Follow-the-regularised-leader with elastic-net penalties updates it text by text.
4. A fifth of the sample is kept aside; on it the temperature is chosen that gives the least
   log loss.  Scores are the calibrated probabilities of the predicted language.
5. All rows are scored where they are read, with the weights that are not zero broadcast.

The languages are the values of ``lang`` in learning rows; each has one column of weights.
A language whose only texts are each larger than its share of the characters is not learned.

Defined cases: null text or text without a letter gives ``und`` and score 0; so does every text
if there is no learning row.  A null lang is not learned from; a null id is scored, not learned
from; ties go to the first language by name; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import map_arrow, pick
from pathweave.llm.textscan import chunks

ORDERS = (1, 2, 3, 4)
BITS = 18
TRAIN_DOCS = 4_000
TRAIN_CHARS = 8_000_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01      # learning rate, its smoothing, and the two penalties
SLICE = 1 << 19                                 # characters whose n-grams are sorted together
UNKNOWN = "und"
_LEVELS = 30


@lru_cache(maxsize=1)
def _in_word() -> np.ndarray:
    """Whether a code point is a letter (2), a mark (1) or anything else (0)."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.int8, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, times) of the distinct n-grams of at most 2**14 texts, sorted; and which texts have a letter."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    kind = _in_word()[codes]
    text_of = np.repeat(np.arange(len(texts)), size + 1)               # from code 1 on; a text and the space behind it
    letters = np.bincount(text_of, kind[1:] == 2, len(texts)) > 0
    word = kind > 0
    keep = word.copy()
    keep[1:] |= word[:-1]                                              # one space behind each word
    keep[0] = True
    at = np.flatnonzero(keep)
    word, codes = word[at], np.where(word[at], codes[at], 32).astype(np.uint64)
    text_of = np.append(0, text_of)[at]
    # A space before a word belongs to the text of the word.
    owner = text_of.copy()
    owner[:-1] = np.where(word[:-1], text_of[:-1], text_of[1:])
    found = []
    h, inner = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(1)
        if n > 2:
            inner = inner[:m] & word[n - 2:n - 2 + m]
        if n in ORDERS:
            good = word[:m] if n == 1 else inner[:m]           # two spaces never stand together
            column = (h[good] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            found.append(owner[:m][good].astype(np.uint32) << np.uint32(BITS) | column.astype(np.uint32))
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint32)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint32(BITS)).astype(np.int64), (keys & np.uint32((1 << BITS) - 1)).astype(np.int64), times, letters


def weighted(text: np.ndarray, column: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF values, of length 1 for every text."""
    x = (1 + np.log(times)) * idf[column]
    norm = np.sqrt(np.bincount(text, x * x, n))
    return x / norm[text]


def _frequencies(batches):
    """Texts -> column, number of texts that have it, of this task."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in chunks(texts, SLICE):
            total += np.bincount(grams(texts[lo:hi])[1], minlength=1 << BITS)
            n += hi - lo
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["gram", "docs"])


def _examples(batches):
    """(lang, h, text) -> lang, h, columns and times as bytes."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in chunks(texts, SLICE):
            text, column, times, _ = grams(texts[lo:hi])
            ends = np.searchsorted(text, np.arange(hi - lo + 1))
            parts = [[x[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] for x in (column, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                              *(pa.array(p, pa.binary()) for p in parts)], names=["lang", "h", "grams", "times"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader (proximal) for a softmax over sparse rows; the last row of the weights is the bias."""

    def __init__(self, n_columns: int, n_classes: int):
        self.z = np.zeros((n_columns + 1, n_classes))
        self.n = np.zeros((n_columns + 1, n_classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    The right language counts (n + 1) / (n + classes) of each text, so that a sample without a mistake has a least loss, too.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    target = np.full(logits.shape, 1 / (n + classes))
    target[np.arange(n), y] = (n + 1) / (n + classes)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(1).mean())

    lo, hi, r = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))


def held_out() -> Column:
    """Whether the row of this doc_id is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(rows: DataFrame, max_docs: int, max_chars: int) -> tuple[DataFrame, list[str]]:
    """(lang, h, text) of a sample within the bounds, and all languages."""
    level = F.floor(-F.log2((F.pmod("h", F.lit(1 << _LEVELS)) + 1) / F.lit(float(1 << _LEVELS)))).cast("int")
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    distinct = hashed.groupBy("lang", "h").agg(F.max(F.length("text")).alias("chars"))
    by_level: dict[str, dict[int, tuple[int, int]]] = {}               # one row for each language and level
    for r in distinct.groupBy("lang", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c")).collect():
        by_level.setdefault(r["lang"], {})[r["level"]] = (r["n"], r["c"])
    langs = sorted(by_level)
    least = {}
    for lang in langs:
        docs, chars = max_docs // len(langs), max_chars // len(langs)
        at = _LEVELS + 1
        while at:
            n, c = by_level[lang].get(at - 1, (0, 0))
            if n > docs or c > chars:
                break
            at, docs, chars = at - 1, docs - n, chars - c
        least[lang] = at
    if not langs:
        return hashed.limit(0), langs
    bound = F.create_map(*[x for lang, at in least.items() for x in (F.lit(lang), F.lit(at))])
    return hashed.filter(level >= bound[F.col("lang")]).dropDuplicates(["lang", "h"]), langs


def train(rows: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> dict | None:
    """The model learned from (lang, text) rows: langs, idf, place of each column in the weights, weights, bias, temperature."""
    counted = map_arrow(rows.select("text"), _frequencies, "gram bigint, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs"))
    counts = counted.toArrow()                                         # at most 2**BITS + 1 rows
    gram, docs = (np.asarray(counts.column(i).combine_chunks()) for i in range(2))
    sample, langs = _sample(rows, max_docs, max_chars)
    if not langs:
        return None
    df = np.zeros(1 << BITS)
    df[gram[gram >= 0]] = docs[gram >= 0]
    idf = np.log((1 + docs[gram < 0].sum()) / (1 + df)) + 1
    table = map_arrow(sample, _examples, "lang string, h bigint, grams binary, times binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    examples = [(langs.index(lang), h, np.frombuffer(g, np.int32), np.frombuffer(t, np.int32)) for lang, h, g, t in
                zip(*(table.column(i).to_pylist() for i in range(4)), strict=True) if g]
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *[g for _, _, g, _ in examples]]))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    data = [(y, h, place[g], weighted(np.zeros(len(g), np.int64), g, t, idf, 1)) for y, h, g, t in examples]
    aside = [x for x in data if x[1] // (1 << _LEVELS) % 5 == 0]
    learn = [x for x in data if x[1] // (1 << _LEVELS) % 5 != 0] or data
    leader = Leader(len(used), len(langs))
    for _ in range(EPOCHS):
        for y, _, at, x in learn:
            leader.learn(at, x, y)
    w = leader.weights()
    some = np.flatnonzero(np.abs(w[:-1]).max(1, initial=0) > 0)
    place[:] = -1
    place[used[some]] = np.arange(len(some))
    logits = np.array([x @ w[at] + w[-1] for _, _, at, x in aside]).reshape(-1, len(langs))
    return {"langs": langs, "idf": idf.astype(np.float32), "place": place, "weights": w[some].astype(np.float32), "bias": w[-1],
            "temperature": temperature(logits, np.array([y for y, *_ in aside], np.int64))}


def _predictor(model) -> Callable:
    def predict(batches):
        m = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in chunks(texts, SLICE):
                text, column, times, letters = grams(texts[lo:hi])
                if m is None:
                    best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                    letters[:] = False
                else:
                    x = weighted(text, column, times, m["idf"], hi - lo)
                    at = m["place"][column]
                    has = at >= 0
                    text, x, at = text[has], x[has], at[has]
                    z = np.stack([np.bincount(text, x * w[at], hi - lo) for w in m["weights"].T], 1) + m["bias"]
                    p = softmax(z / m["temperature"])
                    best, score = p.argmax(1), p.max(1)
                names = [m["langs"][b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names, pa.string()),
                     pa.array(np.where(letters, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])
    return predict


def predict_languages(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows that are not held out."""
    rows = pick(docs, doc_id="bigint", text="string", lang="string").withColumn("held_out", held_out())
    known = rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(train(known.select("lang", "text"), max_docs, max_chars))
    return map_arrow(rows.select("doc_id", "held_out", "text"), _predictor(model),
                     "doc_id bigint, held_out boolean, lang_pred string, score double")
