"""Token counts of whole texts from counts of distinct pre-tokens.

1. Every text is split into pre-tokens; each task adds up how often a pre-token occurs,
   and these partial counts are summed globally.
2. For each distinct pre-token the pieces are counted once; ids are never kept.
3. Each document's pre-token frequencies are joined to the piece counts and summed.

The most frequent pre-tokens (a hot key each) are joined by broadcast: at most
``FREQUENT`` of them, a number that a histogram of the counts proves before anything is
sent.  All others go through a shuffle join on the pre-token, of which no
key can be hot, and their sums are pre-aggregated before they meet the documents.

Splitting a text is local between spaces, so what a space-delimited chunk splits into
is kept in a bounded memory; texts with runs of white space are split as a whole.

Defined cases: null or empty text has 0 bytes and 0 tokens; a special string inside a
text counts as one token, as the library does by default; repeated rows give repeated
rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathweave.llm.bpe_codec import LATIN_END, Memory, byte_symbols
from pathweave.llm.common import map_arrow, pick, shared_table, without_cycles

FREQUENT = 200_000            # pre-tokens that are broadcast, at most
FREQUENT_BYTES = 64          # longer pre-tokens are joined, however frequent
CHUNKS = 150_000             # divided chunks that a task keeps in each of two generations
FLUSH = 600_000               # distinct pre-tokens that a task holds before it sends partial counts
_ODD = re.compile(r" \s|\s |^\s")
_TABLE = "row bigint, doc_id bigint, n_bytes bigint, known bigint, tail array<struct<piece:string,n:bigint>>"


class PreTokens:
    """Pre-tokens (as raw text) and piece counts of a byte-level tokenizer file."""

    def __init__(self, tokenizer_json: str):
        self.library = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.symbol = byte_symbols()

    def _split(self, text: str) -> list[str]:
        if text.isascii() or max(text) < LATIN_END:
            return self.pattern.findall(text)
        # Character classes of rarer scripts differ between Unicode versions: the library's own count.
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def regular(self, text: str) -> bool:
        """Whether the text may be split at spaces, for every space starts a pre-token."""
        return not (_ODD.search(text) or text[-1:].isspace() or any(s in text for s in self.special))

    def whole(self, text: str) -> tuple[Counter, int]:
        """(pre-token -> times it occurs, number of special tokens) of any text."""
        parts, found = [text], 0
        for s in self.special:
            found += sum(part.count(s) for part in parts)
            parts = [x for part in parts for x in part.split(s)]
        return Counter(p for part in parts for p in self._split(part)), found

    def n_pieces(self, pretoken: str) -> int:
        return len(self.library.model.tokenize("".join([self.symbol[b] for b in pretoken.encode()])))


@lru_cache(maxsize=1)
def _pretokens(tokenizer_json: str) -> PreTokens:
    return PreTokens(tokenizer_json)


def _pretoken_counts(tokenizer) -> Callable:
    """Texts -> (pre-token, times it occurs in this part)."""
    @without_cycles
    def count(batches):
        import pyarrow as pa

        parse = _pretokens(tokenizer.value)
        chunks, pieces = Counter(), Counter()

        def send():
            have, split = pieces.get, parse._split
            for chunk, n in chunks.items():
                for p in split(" " + chunk):
                    pieces[p] = have(p, 0) + n
            out = pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())],
                                             names=["piece", "times"])
            chunks.clear()
            pieces.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and parse.regular(text):
                    first, *rest = text.split(" ")
                    chunks.update(rest)
                    pieces.update(parse._split(first))
                elif text:
                    pieces.update(parse.whole(text)[0])
                if len(chunks) + len(pieces) >= FLUSH:
                    yield send()
        yield send()
    return count


def _piece_counts(tokenizer) -> Callable:
    def count(batches):
        import pyarrow as pa

        n_pieces = _pretokens(tokenizer.value).n_pieces
        for batch in batches:
            pieces = pa.array([n_pieces(p) for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=["piece", "times", "pieces"])
    return count


def _frequencies(tokenizer, frequent) -> Callable:
    """Documents -> tokens of their frequent pre-tokens, and the frequencies of all others."""
    @without_cycles
    def split(batches):
        import pyarrow as pa

        parse, known = _pretokens(tokenizer.value), frequent.value

        def divide(chunk: str) -> tuple[int, list[str] | None]:
            """Of a chunk that follows a space: tokens of the frequent pre-tokens, and the others."""
            total, others = 0, None
            for p in parse._split(" " + chunk):
                k = known.get(p)
                if k is not None:
                    total += k
                elif others is None:
                    others = [p]
                else:
                    others.append(p)
            return total, others

        divided = Memory(divide, CHUNKS)

        def counts(text: str) -> tuple[int, dict[str, int]]:
            rest: dict[str, int] = {}
            if parse.regular(text):
                first, *chunks = text.split(" ")
                pieces, total = Counter(parse._split(first)), 0
                for chunk, n in Counter(chunks).items():
                    tokens, others = divided[chunk]
                    total += n * tokens
                    if others is not None:
                        for p in others:
                            rest[p] = rest.get(p, 0) + n
            else:
                pieces, total = parse.whole(text)
            for p, n in pieces.items():
                if p in known:
                    total += n * known[p]
                else:
                    rest[p] = rest.get(p, 0) + n
            return total, rest

        for batch in batches:
            texts = iter(batch.column(2).to_pylist())
            at = 0
            while part := list(islice(texts, 1000)):
                rows = batch.slice(at, len(part))
                at += len(part)
                sizes, sums, offsets, pieces, times = [], [], [0], [], []
                for text in part:
                    total, rest = counts(text) if text else (0, {})
                    pieces += rest.keys()
                    times += rest.values()
                    sizes.append(len(text.encode()) if text else 0)
                    sums.append(total)
                    offsets.append(len(pieces))
                tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(pieces, pa.string()), pa.array(times, pa.int64())], names=["piece", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), tail],
                    names=["row", "doc_id", "n_bytes", "known", "tail"])
    return split


def _known(pieces: DataFrame, frequent: int) -> tuple[Column, dict[str, int]]:
    """Which pre-tokens are broadcast, and their tokens: at most ``frequent``, none over ``FREQUENT_BYTES``."""
    # The least power of two of occurrences that at most ``frequent`` short pre-tokens reach.
    level = F.floor(F.log2(F.col("times"))).cast("int")
    short = F.octet_length("piece") <= FREQUENT_BYTES
    by_level = {r[0]: r[1] for r in pieces.filter(short).groupBy(level).count().collect()}          # 64 rows at most
    least, reach = max(by_level, default=0) + 1, 0
    while least and reach + by_level.get(least - 1, 0) <= frequent:
        least -= 1
        reach += by_level.get(least, 0)
    hot = (F.col("times") >= F.lit(1 << least)) & short
    return hot, {r[0]: r[1] for r in pieces.filter(hot).select("piece", "pieces").collect()}


def token_counts(docs: DataFrame, tokenizer_path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())       # one vocabulary
    texts = pick(docs, doc_id="bigint", text="string")
    partial = map_arrow(texts.select("text"), _pretoken_counts(tokenizer), "piece string, times bigint")
    distinct = partial.groupBy("piece").agg(F.sum("times").alias("times"))
    pieces = shared_table(map_arrow(distinct, _piece_counts(tokenizer), "piece string, times bigint, pieces bigint"), "pieces")

    hot, known = _known(pieces, frequent)
    known = spark.sparkContext.broadcast(known)

    rows = shared_table(map_arrow(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"),
                                  _frequencies(tokenizer, known), _TABLE), "frequencies")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.piece", "t.n")
    sums = (tail.join(pieces.filter(~hot).select("piece", "pieces"), "piece")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest")))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
