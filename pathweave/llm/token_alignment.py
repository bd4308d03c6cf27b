"""Alignment of the tokens of two tokenizers, and how often two ids are linked in the corpus.

1. A text is cut before single spaces; neither tokenizer has a token across such a cut, so
   each distinct chunk is encoded once for a slice of texts (a bounded memory keeps them).
2. Interval coalescing, for all new chunks at once: the byte intervals of all A and B tokens
   are lexsorted by start, the ends are run through ``maximum.accumulate``, and a group
   breaks where a start reaches the running maximum.  Within a group every A token is linked
   with every B token.
3. Per document the chunks' numbers are summed, the group lists are joined, and the linked id
   pairs are made distinct with the times they occur.
4. How many documents hold a pair is a partial aggregation over these lists.  The most
   frequent pairs (at most ``FREQUENT``, proven by a histogram of the counts) are broadcast to
   the documents; all others are joined by a shuffle, in which no key is hot.

Defined cases: a text that is null or empty, or whose joined A or B bytes differ from
space + text (such as one that holds U+2581), has no tokens: zeros and an empty groups column.
Special strings inside a text are plain text.  Repeated rows give repeated rows, each of which
counts as a document; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathweave.llm.bpe_codec import LATIN_END, byte_symbols
from pathweave.llm.common import map_arrow, pick, shared_table
from pathweave.llm.textscan import chunks

FREQUENT = 300_000            # linked pairs that are broadcast, at most
SLICE = 1 << 20               # characters that are aligned together; longer only for one text that is longer
BOOK_BYTES = 24 << 20         # of chunks and group lists that a worker keeps
WIDE = 1 << 16                # links of a group from which on its ids are made distinct first
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s |^\s|\s$")
_DOC = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "pairs array<bigint>, times array<int>")
_SUMS = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
         "n_best bigint, count_sum bigint, tail array<struct<pair:bigint,n:int>>")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + size[i] - 1`` of all i, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of the A and of the B tokens that tile the same bytes, and the number of groups."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    start, end = np.concatenate([a_end - a_size, b_end - b_size]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:len(a_size)], group[len(a_size):], int(breaks.sum()) + (len(order) > 0)


class Pieces:
    """Both tokenizers: ids of chunks, and the bytes of every id."""

    def __init__(self, byte_json: str, piece_model: bytes):
        self.library = Tokenizer.from_str(byte_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True                 # special strings are plain text
        vocab: dict[str, int] = json.loads(byte_json)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        a_bytes = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        # The same vocabulary as ranks; both give the same ids wherever character classes agree.
        self.ranks = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                       mergeable_ranks={t: i for i, t in a_bytes.items()})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.separable = not any(re.search("[^▁]▁", p) for p in names)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(names)]
        self.n_b = n
        self.a_bytes = pa.array([a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)], pa.large_binary())
        self.b_bytes = pa.array(b_bytes, pa.large_binary())
        self.a_size, self.b_size = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (self.a_bytes, self.b_bytes))
        self.numbers = pa.array([str(i) for i in range(max(len(self.a_size), n))], pa.large_string())

    def cut(self, text: str) -> list[str]:
        """Chunks of " " + text without their leading space: a space between two other characters starts one."""
        if not self.separable:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A ids of " " + text and B ids of text, which adds the space itself."""
        a = [self.ranks.encode_ordinary(" " + t) if t.isascii() or max(t) < LATIN_END else None for t in texts]
        rare = [i for i, ids in enumerate(a) if ids is None]
        # Character classes of rarer scripts differ between Unicode versions: the library's own split.
        for i, found in zip(rare, self.library.encode_batch([" " + texts[i] for i in rare], add_special_tokens=False), strict=True):
            a[i] = found.ids
        return a, self.model.encode(texts, num_threads=1)


class Book:
    """Aligned chunks by number: counts, group lists and linked pairs."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.sums = np.zeros((0, 5), np.int64)           # n_a, n_b, n_groups, n_links, 1 if bytes differ
        self.groups = pa.array([], pa.large_string())
        self.first = np.zeros(1, np.int64)               # of a chunk's pairs
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def numbers_of(self, distinct: list[str]) -> np.ndarray:
        if self.bytes > BOOK_BYTES:
            self.forget()
        new = [c for c in distinct if c not in self.number]
        if new:
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self._add(new)
        return np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))

    def _add(self, texts: list[str]) -> None:
        p = self.pieces
        a_lists, b_lists = p.encode(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_lists, b_lists))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_lists, b_lists))
        raw = [b" " + t.encode() for t in texts]
        # The ids of chunks whose bytes differ are left out.
        bad = self._differ(raw, a, n_a, p.a_bytes) | self._differ(raw, b, n_b, p.b_bytes)
        if bad.any():
            a, b = a[np.repeat(~bad, n_a)], b[np.repeat(~bad, n_b)]
            n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
        ga, gb, n = coalesce(p.a_size[a], p.b_size[b])
        in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        chunk_of = np.zeros(n, np.int64)                 # of a group
        chunk_of[ga] = np.repeat(np.arange(len(texts)), n_a)
        n_links = in_a * in_b
        sums = np.stack([n_a, n_b, np.bincount(chunk_of, minlength=len(texts)) if n else 0 * n_a,
                         np.bincount(chunk_of, n_links, len(texts)).astype(np.int64) if n else 0 * n_a, bad.astype(np.int64)], 1)
        pairs, times, owner = self._links(a, b, ga, gb, in_a, in_b, chunk_of)
        lists = self._lists(a, b, ga, gb, in_a, chunk_of, n_a + n_b)
        self.sums = np.concatenate([self.sums, sums])
        self.groups = pa.concat_arrays([self.groups, lists])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(texts)))])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        self.bytes += lists.nbytes + 12 * len(pairs) + sum(map(len, raw)) + 200 * len(texts)

    @staticmethod
    def _differ(raw: list[bytes], ids: np.ndarray, n: np.ndarray, token_bytes: pa.Array) -> np.ndarray:
        """Whether the joined bytes of a chunk's tokens are others than the chunk's own."""
        ends = np.append(0, np.cumsum(n))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), token_bytes.take(pa.array(ids))), pa.scalar(b"", pa.large_binary()))
        return ~np.asarray(pc.equal(joined, pa.array(raw, pa.large_binary())))

    def _links(self, a, b, ga, gb, in_a, in_b, chunk_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, times, chunk) of all A-B pairs that share a group, ordered by chunk."""
        wide = in_a * in_b > WIDE
        first_b = np.cumsum(in_b) - in_b
        near = ~wide[ga]
        size = in_b[ga[near]]
        other = b[_ranges(first_b[ga[near]], size)]
        pairs = np.repeat(a[near], size) * self.pieces.n_b + other
        owner = np.repeat(chunk_of[ga[near]], size)
        times = np.ones(len(pairs), np.int32)
        if wide.any():
            first_a = np.cumsum(in_a) - in_a
            parts = [(pairs, times, owner)]
            for g in np.flatnonzero(wide):
                ids_a, many_a = np.unique(a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
                ids_b, many_b = np.unique(b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
                product = (ids_a[:, None] * self.pieces.n_b + ids_b).ravel()
                parts.append((product, np.outer(many_a, many_b).ravel().astype(np.int32), np.full(len(product), chunk_of[g])))
            pairs, times, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[order], times[order], owner[order]
        return pairs, times, owner

    def _lists(self, a, b, ga, gb, in_a, chunk_of, n_tokens) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of every chunk: tokens by (group, side, order), each with the sign that follows it."""
        group, ids = np.concatenate([ga, gb]), np.concatenate([a, b])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))                # stable, so the order of tokens stays
        group, side, ids = group[order], side[order], ids[order]
        sign = np.zeros(len(ids), np.int64)              # 0 ",", 1 "|", 2 ";", 3 nothing
        if len(ids):
            same = group[1:] == group[:-1]
            sign[:-1] = np.where(same, np.where(side[1:] == side[:-1], 0, 1), np.where(chunk_of[group[1:]] == chunk_of[group[:-1]], 2, 3))
            sign[-1] = 3
        signs = pa.array([",", "|", ";", ""], pa.large_string()).take(pa.array(sign))
        words = pc.binary_join_element_wise(self.pieces.numbers.take(pa.array(ids)), signs, pa.scalar("", pa.large_string()))
        offsets = pa.array(np.append(0, np.cumsum(n_tokens)))
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, words), pa.scalar("", pa.large_string()))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: sums, joined group lists, number of pairs; then all pairs, sorted within a text, and their times."""
        cuts = [self.pieces.cut(t) if t else [] for t in texts]
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts))))
        coded = pa.array(list(chain.from_iterable(cuts)), pa.large_string()).dictionary_encode()
        at = self.numbers_of(coded.dictionary.to_pylist())[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        bad = np.bincount(text_of, self.sums[at, 4], len(texts)) > 0 if len(at) else np.zeros(len(texts), bool)
        keep = ~bad[text_of]
        at, text_of = at[keep], text_of[keep]
        n_chunks = np.bincount(text_of, minlength=len(texts))
        ends = np.append(0, np.cumsum(n_chunks))
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sums[at, :4], 0)])
        sums = running[ends[1:]] - running[ends[:-1]]
        lists = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), self.groups.take(pa.array(at))), pa.scalar(";", pa.large_string()))
        size = np.diff(self.first)[at]
        which = _ranges(self.first[at], size)
        most = len(self.pieces.a_size) * self.pieces.n_b
        keys = np.repeat(text_of, size) * most + self.pairs[which]          # texts of a slice times pairs: below 2**63
        keys, times = _count(keys, self.times[which])
        return sums, lists.to_pylist(), np.bincount(keys // most, minlength=len(texts)), keys % most, times


def _count(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their times."""
    if not len(keys):
        return keys, times
    if times.max() == 1:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.int32)
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first).astype(np.int32)


@lru_cache(maxsize=1)
def _book(byte_json: str, piece_model: bytes) -> Book:
    """One book for all tasks of a worker, so that its memory is kept."""
    return Book(Pieces(byte_json, piece_model))


def _aligner(files) -> Callable:
    def align(batches):
        book = _book(*files.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in chunks(texts, SLICE):
                sums, lists, n_pairs, pairs, times = book.align(texts[lo:hi])
                digest = [hashlib.sha256(x.encode()).hexdigest() if n else "" for x, n in zip(lists, sums[:, 0].tolist(), strict=True)]
                ends = pa.array(np.append(0, np.cumsum(n_pairs)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(sums[:, i].copy()) for i in range(4)),
                     pa.array(digest, pa.string()), pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(times))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
    return align


def _scorer(known) -> Callable:
    """Documents -> sums over the links whose pair is broadcast, and the pairs and times of all others."""
    def score(batches):
        pairs, n_docs, best = known.value
        for batch in batches:
            names = batch.schema.names
            lists, many = batch.column(names.index("pairs")), batch.column(names.index("times"))
            ends = np.asarray(lists.offsets).astype(np.int64)
            at, times = np.asarray(lists.flatten()), np.asarray(many.flatten()).astype(np.int64)
            text_of = np.repeat(np.arange(len(lists)), np.diff(ends))
            place = np.minimum(np.searchsorted(pairs, at), max(len(pairs) - 1, 0))
            hit = pairs[place] == at if len(pairs) else np.zeros(len(at), bool)
            counted, place = times[hit], place[hit]
            sums = []
            for weight in (best[place], n_docs[place]):
                total = np.zeros(len(lists), np.int64)
                np.add.at(total, text_of[hit], counted * weight)
                sums.append(pa.array(total))
            rest = pa.StructArray.from_arrays([pa.array(at[~hit]), pa.array(times[~hit].astype(np.int32))], names=["pair", "n"])
            offsets = np.append(0, np.cumsum(np.bincount(text_of[~hit], minlength=len(lists)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), *sums, pa.ListArray.from_arrays(pa.array(offsets), rest)],
                                             names=[*names[:7], "n_best", "count_sum", "tail"])
    return score


def linked_pairs(linked: DataFrame, n_b: int) -> DataFrame:
    """pair, n_docs (documents that hold it) and is_best (whether its A id has no pair of more documents)."""
    counts = shared_table(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pair-counts")
    a_id = F.expr(f"pair div {n_b}")
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n_docs").alias("most"))          # one row for each A id
    return counts.join(F.broadcast(highest), a_id == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"))


def _known(pairs: DataFrame, frequent: int):
    """Which pairs are broadcast, and these: at most ``frequent``."""
    level = F.floor(F.log2(F.col("n_docs"))).cast("int")
    by_level = {r[0]: r[1] for r in pairs.groupBy(level).count().collect()}               # 64 rows at most
    least, reach = max(by_level, default=0) + 1, 0
    while least and reach + by_level.get(least - 1, 0) <= frequent:
        least -= 1
        reach += by_level.get(least, 0)
    hot = F.col("n_docs") >= F.lit(1 << least)
    table = pairs.filter(hot).select("pair", "n_docs", F.col("is_best").cast("bigint").alias("best")).toArrow()
    ids, n_docs, best = (np.asarray(table.column(i).combine_chunks()) if table.num_rows else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(ids)
    return hot, (ids[order], n_docs[order], best[order])


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``byte_path`` is a byte-level tokenizer file (A), ``piece_path`` a sentencepiece model with
    byte fallback (B).  Both are read on the driver and broadcast: the size of two vocabularies.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        files = f.read(), g.read()
    n_b = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    texts = pick(docs, doc_id="bigint", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    linked = shared_table(map_arrow(texts, _aligner(context.broadcast(files)), _DOC), "linked-pairs")
    pairs = shared_table(linked_pairs(linked, n_b), "pairs")
    hot, known = _known(pairs, frequent)
    rows = shared_table(map_arrow(linked, _scorer(context.broadcast(known)), _SUMS), "alignments")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.pair", "t.n")
    sums = (tail.join(pairs.filter(~hot), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("n_docs")).alias("c")))
    zero = F.lit(0).cast("bigint")
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("c", zero)).alias("count_sum"), "groups_sha256")
