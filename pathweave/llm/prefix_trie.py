"""Trie of the conversations' common prefixes, built as a burst trie.

1. A turn is named by a 128-bit checksum of role and text; a conversation is the list of its
   turns' names and word counts.  Equal conversations are one row with a count, so a group of
   copies is never carried as such.
2. All lists start in one suffix container under the root.  A container of more than
   ``CONTAINER`` turns is burst: its common prefix becomes a chain of nodes (the trie head), and
   the next turn's name deals its rows out to smaller containers.  Common prefixes are taken at
   once, so the number of rounds follows the branching, not the length.
3. What is left is dealt out to shards by container and sorted; a sweep over the sorted lists
   opens and closes nodes.  It holds one container, bounded by ``CONTAINER``.
4. Sums of subtrees are folded from the containers' top nodes up to the heads, round by round.
5. The ids of the conversations that end at a node are range-partitioned by (node, id) and
   written as text pieces there; only the SHA-256 of the pieces runs in id order for each node.

One conversation's names (16 bytes a turn, never its texts) are held together.

Defined cases: a null role or text is empty; turns of one number are ordered by checksum, null
numbers come first; repeated rows are repeated turns; rows without a conv_id belong to no
conversation and are left out; an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import map_arrow, pick, shared_table

CONTAINER = 50_000            # turns of a suffix container that is swept; more are burst, unless it is one list
PIECE = 1 << 16               # ids in one piece of text
SPAN, HEADS = 20, 4           # of the rebuilt conversations: base is every 20th id, at most 3 turns are taken from it
_WORD = r"[^\x20\x09-\x0D]+"
_NODES = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved_tokens bigint, key binary, above binary")
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_NONE = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, ids (checksums of the turns) and words (word counts), in the order of the turns."""
    rows = pick(conversations, conv_id="bigint", turn="bigint", role="string", text="string").filter(F.col("conv_id").isNotNull())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), name.alias("id"),
                    F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("words"))
    lists = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def rebuild(lists: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of its base c - c % 20 in place of its own; h is crc32(c) % 4."""
    lists = shared_table(lists, "turn-lists")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % SPAN
    # Only ids that are a base, and only the turns that can be taken.
    heads = lists.filter(F.col("conv_id") % SPAN == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, HEADS - 1).alias(f"head_{c}") for c in ("ids", "words")])
    joined = lists.withColumn("base", base).join(heads, "base", "left")

    def whole(c: str) -> Column:
        own = F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))
        return F.when(F.col(f"head_{c}").isNull(), own).otherwise(F.concat(F.slice(f"head_{c}", F.lit(1), h), own)).alias(c)

    return joined.select("conv_id", whole("ids"), whole("words"))


def _digests(batches):
    """(key, piece) in order -> key, sha256; a key's pieces follow one another."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(piece)
            else:
                digest.update(b"," + piece)
        yield _pairs(done)
    if key is not None:
        yield _pairs([(key, digest.hexdigest())])


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                      names=["key", "ends_sha256"])


def _pieces(batches):
    """Sorted (key, conv_id) -> key, first id and ids as text; at most ``PIECE`` ids in one row."""
    for batch in batches:
        keys, ids = batch.column(0), np.asarray(batch.column(1))
        coded = np.asarray(keys.dictionary_encode().indices)
        starts = np.flatnonzero(np.append(True, coded[1:] != coded[:-1])) if len(coded) else np.zeros(0, np.int64)
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            for at in range(lo, hi, PIECE):
                some = ids[at:min(at + PIECE, hi)].tolist()
                out.append((keys[at].as_py(), some[0], ",".join(map(str, some)).encode()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                                          pa.array([o[2] for o in out], pa.binary())], names=["key", "first", "piece"])


def _end_digests(lists: DataFrame) -> DataFrame:
    ordered = lists.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = map_arrow(ordered, _pieces, "key binary, first bigint, piece binary")
    ordered = pieces.repartition("key").sortWithinPartitions("key", "first")
    return map_arrow(ordered, _digests, "key binary, ends_sha256 string")


def _sweep(batches):
    """Rows sorted by container and list -> nodes; a container's top node carries the container above it."""
    current, stack, before, out, context = None, [], [], [], None

    def close(keep: int) -> None:
        """Close the nodes below the first ``keep`` ones; a node's children learn its smallest member when it closes."""
        while len(stack) > keep:
            depth, words, n, first, children, leaves, saved, key, below = stack.pop()
            for record in below:
                record[2] = first
                out.append(record)
            leaves, saved = leaves or 1, saved + (n - 1) * words
            record = [first, depth, None, n, children, leaves, saved, key, None]
            if stack:
                up = stack[-1]
                up[2] += n
                up[3] = min(up[3], first)
                up[4] += 1
                up[5] += leaves
                up[6] += saved
                up[8].append(record)
            else:
                record[2], record[8] = context
                out.append(record)

    for batch in batches:
        for row in batch.to_pylist():
            if row["head"] != current:
                close(0)
                current, context, before = row["head"], (row["above_conv_id"], row["above"]), None
            ids, words = row["ids"], row["words"]
            if before is None:
                stack.append([row["depth"], row["top_words"], 0, row["first"], 0, 0, 0, None, []])
                shared = 0
            else:
                shared = 0
                for x, y in zip(ids, before, strict=False):
                    if x != y:
                        break
                    shared += 1
                close(1 + shared)
            for k in range(shared, len(ids)):
                stack.append([row["depth"] + k + 1, words[k], 0, row["first"], 0, 0, 0, None, []])
            end = stack[-1]
            end[2] += row["n"]
            end[3], end[7] = min(end[3], row["first"]), row["key"]
            before = ids
            if len(out) >= 10_000:
                yield _records(out)
                out.clear()
    close(0)
    yield _records(out)


def _records(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                      names=[*_COLUMNS, "key", "above"])


def _burst(containers: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(containers to sweep, burst heads, containers below them); None, None if no container is over the limit."""
    sizes = containers.groupBy("head").agg(F.sum(F.size("ids")).alias("turns"), F.count(F.lit(1)).alias("rows"))
    large = shared_table(sizes.filter((F.col("turns") > limit) & (F.col("rows") > 1)).select("head"), "large")
    if large.isEmpty():
        return containers, None, None
    rest = containers.join(large, "head", "left_anti")
    rows = containers.join(large, "head")
    # The common prefix of all lists is that of the least and the greatest.
    one = F.struct("ids", "words")
    ends = rows.groupBy("head", "above", "above_conv_id", "depth", "top_words").agg(
        F.min(one).alias("low"), F.max("ids").alias("high"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"))
    differs = F.array_position(F.zip_with("low.ids", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    shared = F.when(differs == 0, F.size("high")).otherwise(differs - 1)
    heads = ends.withColumn("shared", shared).select(
        "head", "above", "above_conv_id", "depth", "n_convs", "conv_id", "shared",
        F.concat(F.array("top_words"), F.slice("low.words", F.lit(1), F.col("shared"))).alias("path_words"))
    heads = shared_table(heads, "heads")
    dealt = rows.drop("above", "above_conv_id").join(heads.select("head", "shared", F.col("conv_id").alias("above_conv_id")), "head")
    at = F.col("shared")
    over = dealt.filter(F.size("ids") > at)
    name = F.unhex(F.md5(F.concat("head", F.element_at("ids", at + 1))))
    below = over.select(
        name.alias("head"), F.col("head").alias("above"), "above_conv_id", (F.col("depth") + at + 1).alias("depth"),
        F.element_at("words", at + 1).alias("top_words"), "n", "first", "key",
        *[F.slice(c, at + 2, F.size(c) - at - 1).alias(c) for c in ("ids", "words")])
    # A list that is the common prefix itself ends at the branching node.
    ended = dealt.filter(F.size("ids") == at).select("head", "key")
    return rest, heads.join(ended, "head", "left"), shared_table(below, "containers")


def prefix_trie(lists: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of (conv_id, ids, words): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.
    """
    key = F.unhex(F.md5(F.concat_ws("", F.transform("ids", F.hex)).cast("binary")))
    lists = shared_table(lists.withColumn("key", key), "lists")
    distinct = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.first("ids").alias("ids"),
                                        F.first("words").alias("words"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    todo = shared_table(distinct.select(
        F.lit(b"root").alias("head"), none.cast("binary").alias("above"), none.cast("bigint").alias("above_conv_id"),
        zero.alias("depth"), zero.alias("top_words"), "n", "first", "key", "ids", "words"), "containers")
    small, rounds = [], []
    while todo is not None:
        rest, heads, todo = _burst(todo, limit)
        small.append(rest)
        if heads is not None:
            rounds.append(heads)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    swept = shared_table(map_arrow(rest.repartition("head").sortWithinPartitions("head", "ids"), _sweep, _NODES), "swept")
    nodes = [swept.drop("above")]

    def tops(df: DataFrame) -> DataFrame:
        sums = df.filter(F.col("above").isNotNull()).groupBy("above")
        return sums.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    from_swept, below = tops(swept), None
    for heads in reversed(rounds):
        children = from_swept if below is None else from_swept.unionByName(tops(below)).groupBy("above").agg(
            *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        folded = heads.join(children.withColumnRenamed("above", "head"), "head")
        # Words that the chain from a place on saves, and those of all its subtrees.
        chain = F.transform("path_words", lambda w, i: (F.col("n_convs") - 1) * F.aggregate(
            F.slice("path_words", i + 1, F.size("path_words") - i), F.lit(0).cast("bigint"), lambda a, b: a + b) + F.col("saved_tokens"))
        folded = shared_table(folded.withColumn("saved", chain), "folded")
        last = F.col("i") == F.col("shared")
        nodes.append(folded.select("*", F.posexplode("saved").alias("i", "total")).select(
            "conv_id", (F.col("depth") + F.col("i")).alias("depth"),
            F.when(F.col("i") == 0, F.col("above_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"), "n_leaves",
            F.col("total").alias("saved_tokens"), F.when(last, F.col("key")).alias("key")))
        below = folded.select("above", "n_leaves", F.col("saved")[0].alias("saved_tokens"))
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    ended = every.filter(F.col("key").isNotNull()).join(_end_digests(lists), "key")
    inner = every.filter(F.col("key").isNull()).withColumn("ends_sha256", F.lit(_NONE))
    return ended.select(*_COLUMNS, "ends_sha256").unionByName(inner.select(*_COLUMNS, "ends_sha256"))


def conversation_trie(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuild(turn_lists(conversations)), limit)
