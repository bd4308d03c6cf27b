"""Byte-pair encoding and decoding of whole texts with a contiguous rank array.

A word is held as a list of part boundaries and a list with the merge rank of every
two adjacent parts.  The smallest rank is found by a scan, its boundary is deleted and
only the ranks of the neighbours are looked up again.  For short words this beats a
heap, as everything lies in two small lists; words of more than ``SHORT`` symbols take a
heap with the same order (rank, then position), so that a text without spaces does not
cost the square of its length.

Words are found as the tokenizer file says: special strings first, then NFC, lower
case and the splitting pattern.  No word holds a space, so the unit that is looked up
and kept in a bounded memory is a space-delimited chunk.  Texts are encoded where they
are read: nothing is shuffled, and batches bound the memory.

Defined cases: null or empty text has no ids (checksums of the empty string);
repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from pathweave.llm.common import map_arrow, pick, release, without_cycles
from pathweave.llm.textscan import chunks

SHORT = 32                    # symbols of a word up to which the rank array is scanned
ROWS = 4096                   # words in one array
SLICE = 1 << 20               # characters whose new chunks are encoded together
MEMORY = 60_000               # chunks kept in each of two generations; about 200 bytes each
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_SLOT_BITS = 18
_HASH = np.uint64(0x9E3779B97F4A7C15)
LATIN_END = "\u0250"          # below it, character classes are the same in all Unicode versions in use


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Memory(dict):
    """A dict that fills itself with ``make`` and keeps at most two generations of ``size`` entries."""

    def __init__(self, make: Callable, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if key in self.old:
            value = self.old[key]
        else:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class WordCodec:
    """Codec for one tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, tokenizer_json: str):
        self.source = tokenizer_json
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        # Two ids -> rank, by open addressing; rank -> id.
        self.slot_key, self.slot_rank = np.full(1 << _SLOT_BITS, -1, np.int64), np.zeros(1 << _SLOT_BITS, np.int32)
        self.merged = np.zeros(len(model["merges"]), np.int32)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[left] << 32 | vocab[right]
            slot = self._slot(key)
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) & ((1 << _SLOT_BITS) - 1)
            self.slot_key[slot], self.slot_rank[slot] = key, rank
            self.merged[rank] = vocab[left + right]
        self.inner = [vocab.get(c, -1) for c in byte_symbols()]
        self.last = [vocab.get(c + self.end, -1) for c in byte_symbols()]
        if min(self.inner + self.last) < 0:
            raise ValueError("the vocabulary lacks a byte")
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names: list[str | None] = [None] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token
        self.id_names, self.token_names = (pa.array(x, pa.large_string()) for x in ([str(i) for i in range(len(names))], names))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.chunk = Memory(lambda chunk: self._chunks([chunk])[0])

    @cached_property
    def library(self):
        """The library's own tokenizer, loaded when a text goes beyond Latin letters."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    @staticmethod
    def _slot(key: int) -> int:
        return (key * int(_HASH) & (1 << 64) - 1) >> (64 - _SLOT_BITS)

    def _rank_of(self, left: int, right: int) -> int:
        """Merge rank of two ids, -1 if there is no merge."""
        key = left << 32 | right
        slot = self._slot(key)
        while (found := int(self.slot_key[slot])) >= 0:
            if found == key:
                return int(self.slot_rank[slot])
            slot = (slot + 1) & ((1 << _SLOT_BITS) - 1)
        return -1

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; words of similar length share one array."""
        out: list[list[int]] = [[]] * len(words)
        short = []
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = self._heap([x for x in [*[self.inner[b] for b in word[:-1]], self.last[word[-1]]] if x >= 0])
            else:
                short.append(i)
        short.sort(key=lambda i: len(words[i]))
        lo = 0
        while lo < len(short):
            longest, hi = len(words[short[lo]]) * 5 // 4 + 1, lo + 1
            while hi < min(len(short), lo + ROWS) and len(words[short[hi]]) <= longest:
                hi += 1
            some = short[lo:hi]
            for i, ids in zip(some, self._scan([words[i] for i in some]), strict=True):
                out[i] = ids
            lo = hi
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, ``none`` where there is no merge (open addressing, linear probing)."""
        key = left.astype(np.int64) << 32 | right
        slot = (key.astype(np.uint64) * _HASH >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = np.full(len(key), len(self.merged), np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))          # -1 stands for no part
        while len(todo):
            found = self.slot_key[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_rank[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
        return out

    def _scan(self, words: list[bytes]) -> list[list[int]]:
        """The contiguous rank array, for many words at once.

        A row holds the parts of a word between its boundaries and, next to them, the ranks of
        adjacent parts.  In every round each row gives up the boundary of its least rank, what
        lies behind moves up, and the two ranks beside the new part are looked up.
        """
        none, size = len(self.merged), max(map(len, words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8).reshape(len(words), size)
        column = np.arange(size)
        parts = self.inner_ids[raw]
        ends = length - 1
        rows = np.arange(len(words))
        parts[rows, ends] = self.last_ids[raw[rows, ends]]
        parts[column > ends[:, None]] = -1
        near = np.full((len(words), size), none, np.int32)         # near[:, i]: parts i and i + 1
        if size > 1:
            near[:, :-1] = self._rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), -1)
        out, alive = parts, rows                                   # finished rows are written back to ``out``
        while len(alive):
            i = near.argmin(1)
            r = np.arange(len(i))
            low = near[r, i]
            busy = low < none
            if not busy.all():
                out[alive[~busy]] = parts[~busy]
                alive, parts, near, i, low = alive[busy], parts[busy], near[busy], i[busy], low[busy]
                r = np.arange(len(i))
                if not len(alive):
                    break
            behind = column[:-1] > i[:, None]                      # what lies behind the deleted boundary moves up
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            near[:, :-1] = np.where(column[:-1] >= i[:, None], near[:, 1:], near[:, :-1])
            near[:, -1] = none
            parts[r, i] = self.merged[low]
            has = np.flatnonzero(i > 0)
            near[has, i[has] - 1] = self._rank(parts[has, i[has] - 1], parts[has, i[has]])
            has = np.flatnonzero(i + 1 < size)
            near[has, i[has]] = self._rank(parts[has, i[has]], parts[has, i[has] + 1])
        return [[x for x in row if x >= 0] for row in out.tolist()]

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        parts: list[int | None] = list(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        todo: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (r := self._rank_of(parts[a], parts[b])) >= 0:
                heapq.heappush(todo, (r, a, parts[a], parts[b]))

        row = np.array(ids, np.int32)
        ranks = self._rank(row[:-1], row[1:])
        for a in np.flatnonzero(ranks < len(self.merged)).tolist():
            todo.append((int(ranks[a]), a, ids[a], ids[a + 1]))
        heapq.heapify(todo)
        while todo:
            low, i, left, right = heapq.heappop(todo)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue                               # one of the two has been merged meanwhile
            parts[i], parts[j] = int(self.merged[low]), None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _split(self, piece: str) -> list[bytes]:
        """The words of a text without special strings, normalised."""
        if piece.isascii():
            return [w.encode() for w in self.words.findall(piece.lower())]
        if max(piece) < LATIN_END:
            return [w.encode() for w in self.words.findall(unicodedata.normalize("NFC", piece).lower())]
        # Character classes of rarer scripts differ between Unicode versions: the library's own count.
        clean = self.library.normalizer.normalize_str(piece)
        return [bytes(self.byte_of[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids (32 bits each) of texts without spaces."""
        words: dict[bytes, int] = {}
        plans = []                                     # of each chunk: words by number, special ids as negative numbers
        for chunk in chunks:
            plan = []
            for piece in self.special_split.split(chunk) if self.special_split and "<|" in chunk else [chunk]:
                if piece in self.special:
                    plan.append(~self.special[piece])
                elif piece:
                    plan += [words.setdefault(w, len(words)) for w in self._split(piece)]
            plans.append(plan)
        coded = [array("i", ids).tobytes() for ids in self.merge(list(words))]
        return [coded[plan[0]] if len(plan) == 1 and plan[0] >= 0 else
                b"".join([coded[p] if p >= 0 else array("i", [~p]).tobytes() for p in plan]) for plan in plans]

    @staticmethod
    def _lowered(text: str) -> str:
        """Lowered at once where that is all the normalising there is (Latin-1 text)."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                pass
        return text

    def _results(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of every chunk; those that are not in memory are encoded together.

        Punctuation behind a word is a word of its own, so it is encoded apart.
        """
        memory = self.chunk
        out = {c: memory[c] for c in chunks if c in memory}
        old = {c: memory.old[c] for c in chunks if c not in out and c in memory.old}
        new = [c for c in chunks if c not in out and c not in old]
        split = []
        for c in new:
            core = c.rstrip(_MARKS)
            if core != c and core and core[-1] < "\u0100" and core[-1].isalnum() and "<|" not in c:
                split.append((c, core, c[len(core):]))
        apart = {c for c, _, _ in split}
        words = {c for c in new if c not in apart} | {x for _, *parts in split for x in parts}
        known = {c: memory[c] if c in memory else memory.old.get(c) for c in words}
        words = [c for c, value in known.items() if value is None]
        for lo in range(0, len(words), 50_000):
            some = words[lo:lo + 50_000]
            known.update(zip(some, self._chunks(some), strict=True))
        for c, core, tail in split:
            known[c] = known[core] + known[tail]
        for c, value in [*old.items(), *known.items()]:
            memory.keep(c, value)
        return {**out, **old, **known}

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by spaces, decoded text) of each text.

        Chunks are told apart and their results put together again as Arrow
        arrays; Python sees each different chunk once.
        """
        lists = pc.split_pattern(pa.array([self._lowered(t) for t in texts], pa.large_string()), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        results = self._results(chunks)
        found = [results[c] for c in chunks]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size))), pa.array(np.frombuffer(b"".join(found), np.int32)))
        ids = ids.take(pa.array(at, pa.int64())).flatten()
        edges = np.append(0, np.cumsum(size[at]))[offsets]

        def joined(names) -> list[str]:
            parts = pa.LargeListArray.from_arrays(pa.array(edges), names.take(ids))
            return pc.binary_join(parts, pa.scalar(" ", pa.large_string())).to_pylist()

        return list(zip(np.diff(edges).tolist(), joined(self.id_names), joined(self.token_names), strict=True))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does for files without a decoder; special tokens stay."""
        names = [self.token_names[i].as_py() for i in ids if 0 <= i < len(self.token_names)]
        return " ".join([t for t in names if t is not None])


@lru_cache(maxsize=1)
def _codec(tokenizer_json: str) -> WordCodec:
    """One codec for all tasks of a worker, so that its memory is kept."""
    codec = WordCodec(tokenizer_json)
    release()                                          # the parsed file
    return codec


def _coder(tokenizer, with_ids: bool) -> Callable:
    @without_cycles
    def code(batches):
        codec = _codec(tokenizer.value)
        for batch in batches:
            n, ids, decoded, kept = [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts, SLICE):
                for count, numbers, tokens in codec.encode(texts[lo:hi]):
                    n.append(count)
                    ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(tokens.encode()).hexdigest())
                    if with_ids:
                        kept.append([int(x) for x in numbers.split()])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return code


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row.

    The tokenizer file is read on the driver and broadcast: its size is that of one vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_arrow(pick(docs, doc_id="bigint", text="string"), _coder(tokenizer, with_ids),
                     schema + (", ids array<int>" if with_ids else ""))


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: ids and checksums of the documents that are left."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
