"""Benchmark decontamination: rolling word windows of documents against a broadcast hash set.

The benchmark is split into blocks of a bounded number of bytes; each block becomes
a hash set of its windows (ten consecutive words, or the whole item if it has fewer)
and is broadcast.  Documents are scanned block after block by narrow stages: nothing is
shuffled, and a hot source or passage costs no more than its own words.  A hash hit
counts only after its words were compared with the item's words.

Words: A-Z lowered, runs of digits, letters a-z and non-ASCII characters.

Defined cases: null or empty text has no words; an item without words has no
window; several items may share a window and all count; repeated item rows count once;
items with a null id mark words but are not listed; an empty benchmark marks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import Carried, drop_tables, map_arrow, nullable, pick, shared_table
from pathweave.llm.textscan import ALNUM, U, Words, chunks, sequence_hash

WINDOW = 10
BLOCK_BYTES = 4 << 20        # benchmark text in one broadcast block, at most (a longer item is a block of its own); about 20 MB of index
BLOCKS_AT_ONCE = 8           # Python stages in one plan; then the marks are written
_SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


class WindowSet:
    """Windows of one block of items, by window length."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.by_length: dict[int, dict[int, list[tuple[bytes, set[str]]]]] = {}
        for item_id, text in items:
            w = Words([(text or "").encode()], ALNUM)
            n = len(w.hash)
            k = min(window, n)
            for i in range(n - k + 1 if k else 0):
                found = self.by_length.setdefault(k, {}).setdefault(sequence_hash(w.hash[i:i + k]), [])
                words = b" ".join(w.words(i, i + k))
                ids = next((ids for have, ids in found if have == words), None)
                if ids is None:
                    found.append((words, ids := set()))
                if item_id is not None:
                    ids.add(str(item_id))

    def finish(self) -> WindowSet:
        """Bitmaps of 22 bits of the hashes, to drop nearly all windows at once."""
        self.maps = {}
        for k, found in self.by_length.items():
            bits = np.zeros(1 << 22, bool)
            bits[np.fromiter(found, U, len(found)) & U((1 << 22) - 1)] = True
            self.maps[k] = bits
        return self

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of each verified window."""
        for k, found in self.by_length.items():
            at, g = words.grams(k)
            near = np.flatnonzero(self.maps[k][g & U((1 << 22) - 1)])
            for i, h in zip(at[near].tolist(), g[near].tolist(), strict=True):
                for have, ids in found.get(h, ()):
                    if have == b" ".join(words.words(i, i + k)):
                        yield i, k, ids


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[WindowSet]:
    """The different items in blocks of at most ``block_bytes`` (or one item), one at a time on the driver."""
    items = pick(benchmark, item_id="bigint", text="string").filter("text != ''").distinct()
    items = shared_table(items.withColumn("size", F.octet_length("text").cast("bigint")), "benchmark")
    for block in _split(items, block_bytes, 0):
        yield WindowSet([tuple(r) for r in block.select("item_id", "text").collect()])


def _split(items: DataFrame, block_bytes: int, depth: int) -> Iterator[DataFrame]:
    """Parts of ``items`` whose real bytes are in the limit; a part over it is split again by another hash."""
    total, rows = items.agg(F.sum("size"), F.count(F.lit(1))).first()
    if rows == 1 or 0 < (total or 0) <= block_bytes:
        yield items
    elif rows:
        n = max(2, math.ceil(total / block_bytes))
        for b in range(n):
            yield from _split(items.filter(F.pmod(F.xxhash64(F.lit(depth), "item_id", "text"), F.lit(n)) == b), block_bytes, depth + 1)


def _merged(hits: list[tuple[int, int]], before: list[dict], words: Words, first: int) -> list[dict]:
    """Word intervals [first, last] of one document, merged, with their bytes."""
    out: list[list[int]] = []
    for a, b in sorted([(i - first, i - first + k - 1) for i, k in hits] + [(s["first"], s["last"]) for s in before]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b, "start": int(words.starts[first + a]), "end": int(words.ends[first + b])}
            for a, b in out]


def _scanner(index, text_at: int, spans_at: int) -> Callable:
    def scan(batches):
        import pyarrow as pa

        windows = index.value.finish()
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            n_words, spans, items = [], batch.column(spans_at).to_pylist(), batch.column(spans_at + 1).to_pylist()
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi], ALNUM)
                n_words += np.diff(words.first).tolist()
                hits: dict[int, list] = {}
                for i, k, ids in windows.hits(words):
                    d = int(words.doc[i])
                    hits.setdefault(d, []).append((i, k))
                    items[lo + d] = [*{*items[lo + d], *ids}]
                for d, found in hits.items():
                    spans[lo + d] = _merged(found, spans[lo + d], words, int(words.first[d]))
            cols = [*batch.columns[:spans_at],
                    pa.array(spans, batch.schema.field(spans_at).type), pa.array(items, batch.schema.field(spans_at + 1).type),
                    pa.array(n_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
    return scan


def mark(frame: DataFrame, text: str, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``frame`` with _spans (hit word intervals and their bytes), _items and _n_words; ``text`` is its text column."""
    spark = frame.sparkSession
    empty_items = F.array().cast("array<string>")
    marked = frame.select("*", F.array().cast(_SPANS).alias("_spans"), empty_items.alias("_items"),
                          F.lit(0).cast("bigint").alias("_n_words"))
    at = frame.columns.index(text)
    blocks, before = 0, []
    for windows in benchmark_blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast(windows)
        marked = map_arrow(marked, _scanner(index, at, len(frame.columns)), nullable(marked.schema))
        blocks += 1
        if blocks % BLOCKS_AT_ONCE == 0:
            marked = shared_table(marked, "marks")
            drop_tables(*before)
            before = [marked]
    if not blocks:                                   # words are counted all the same
        index = spark.sparkContext.broadcast(WindowSet([]))
        marked = map_arrow(marked, _scanner(index, at, len(frame.columns)), nullable(marked.schema))
    return marked


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans, items (distinct ids as strings, sorted)."""
    marked = mark(pick(docs, doc_id="bigint", text="string"), "text", benchmark, block_bytes)
    n_hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)
    return marked.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"),
                         F.col("_spans").alias("spans"), F.array_sort(F.array_distinct("_items")).alias("items"))


def _cutter(text_at: int, spans_at: int) -> Callable:
    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts, spans = batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(spans_at).to_pylist()
            for d, found in enumerate(spans):
                if found:
                    t, edges = texts[d], [0, *(x for s in found for x in (s["start"], s["end"])), len(texts[d])]
                    texts[d] = b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
            kind = batch.schema.field(text_at).type
            cols = [c if i != text_at else pa.array(texts, pa.binary()).cast(kind) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
    return cut


def remove_leaks(spark, docs: DataFrame, sf_dir: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pipeline stage: hit spans are cut out of the texts; documents of which no word is left go.

    Documents without a hit stay as they are.  ``n_chars``, if there is one, follows the text.
    """
    rows = Carried(docs)
    text = f"_c{rows.names.index('text')}"
    marked = mark(rows.frame, text, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block_bytes)
    n_hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)
    left = marked.filter((F.size("_spans") == 0) | (n_hit < F.col("_n_words")))
    cut = map_arrow(left, _cutter(rows.names.index("text"), len(rows.names)), nullable(left.schema))
    size = F.when(F.size("_spans") > 0, F.length(text)).otherwise(
        rows.col("n_chars") if "n_chars" in rows.names else F.lit(0))
    return rows.back(cut, n_chars=size)
