"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row for each different set of n-grams (copies share one) and a
column for each n-gram.  Two rows link when their Jaccard similarity reaches the limit.

* Columns are ordered, common n-grams last: how common is estimated from counts by hash
  over all texts.  Any order is right; this one keeps the products small.  Rows that link
  share a column among the first ``n - ceil(limit * n) + 1`` of each, so only these enter.
* Columns of up to ``DENSE`` rows are multiplied out; the overlap counts of a pair are added
  up and the pair is dropped if its count, plus the columns of the row that ends first
  that have not entered, stays below the overlap that the two sizes demand.
* Columns with more rows are dense blocks, multiplied in products of ``BLOCK`` x ``BLOCK`` rows
  at most.  A product gives a spanning forest of its links and, for each of its rows, with how many
  documents it links, never all pairs.  A pair that meets in several blocks is counted in the least.
  Where components alone are asked for, each row is first compared with one row of its block (its
  hub), and rows that link to the hub are not compared among one another.  ``all_links`` gives every pair.
* What is left is compared exactly, on the whole sets, and the links give components.

Copies, hot columns and blocks are pre-aggregated or split by a hash; no task gets a whole
group.  Sets are fetched only for rows that are still in question.

Defined cases: a text with fewer words than ``N`` but some is one n-gram; null or empty text
and text without words has no set and links with nothing; equal ids with different texts
are different rows; a null id is never the least id of a component; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import Carried, drop_tables, hash_bitmap, in_bitmap, likely_in, map_arrow, pick, shared_table
from pathweave.llm.components import components
from pathweave.llm.textscan import SPACED, U, Words, chunks, mix, sequence_hash

N = 4
PERCENT = 85                 # Jaccard similarity in percent
STAGE_N, STAGE_PERCENT = 5, 80               # of the pipeline stage; N and PERCENT are those of the query
DENSE = 64                   # rows of a column from which on it is a dense block
BLOCK = 512                  # rows of a block of a product
BLOCK_GRAMS = 1 << 19        # and their n-grams; one set may be larger
BUCKET_BITS = 22             # n-gram counts are kept by the first 22 bits of the hash
MAX_COMMON = 1 << 18         # buckets that are told apart as common, at most


def gram_sets(texts: list[bytes], n: int, levels: np.ndarray | None):
    """For each text its n-grams: with ``levels``, sorted distinct (level, hash) keys, else all hashes."""
    words = Words(texts, SPACED)
    at, g = words.grams(n)
    if levels is None:
        return g
    g = _keys(g, levels)
    edges = np.searchsorted(words.doc[at] if len(at) else at, np.arange(len(texts) + 1))
    out = []
    for d in range(len(texts)):
        a, b = words.first[d], words.first[d + 1]
        if 0 < b - a < n:
            out.append(_keys(np.array([sequence_hash(words.hash[a:b])], U), levels))
        else:
            out.append(np.unique(g[edges[d]:edges[d + 1]]))
    return out


def _keys(g: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return (levels[(g >> U(64 - BUCKET_BITS)).astype(np.int64)].astype(U) << U(58)) | (g >> U(6))


def prefix_size(n: int, percent: int) -> int:
    """Columns of a row of ``n`` of which one at least is shared by every row that links to it."""
    return n - -(-percent * n // 100) + 1


def _common(n: int):
    """Texts -> (bucket, count) of the buckets that are far above the mean within one task."""
    def count(batches):
        import pyarrow as pa

        seen = np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                g = gram_sets(texts[lo:hi], n, None)
                at, n_at = np.unique((g >> U(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
                seen[at] += n_at.astype(np.int32)
        at = np.flatnonzero(seen >= max(6, 4 * seen.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at].astype(np.int64))], names=["bucket", "n"])
    return count


def _levels(texts: DataFrame, n: int) -> np.ndarray:
    """Level 0 for most buckets, else the number of binary digits of the count; at most ``MAX_COMMON`` are raised."""
    counts = map_arrow(texts.select("text"), _common(n), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    digits = F.least(F.length(F.bin("n")), F.lit(31)).cast("int")
    counts = shared_table(counts.select("bucket", digits.alias("level")), "common")
    sizes = {r[0]: r[1] for r in counts.groupBy("level").count().collect()}              # 31 rows at most
    least, reach = 32, 0
    while least > 1 and reach + sizes.get(least - 1, 0) <= MAX_COMMON:
        least -= 1
        reach += sizes.get(least, 0)
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    for bucket, level in counts.filter(F.col("level") >= least).collect():
        levels[bucket] = level
    drop_tables(counts)
    return levels


def _fingerprint(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent fingerprints of a set; the first names its row of the matrix."""
    if not len(s):
        return 0, 0
    sums = np.array([np.add.reduce(mix(s ^ U(seed))), np.add.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5)))], U)
    a, b = mix(sums + U(len(s))).view(np.int64).tolist()
    return a, b


def _describe(levels, n: int, percent: int, seed: int):
    """Texts -> size and fingerprints of their sets, and, once for each task, the columns that enter the product."""
    def scan(batches):
        import pyarrow as pa

        sent: set[int] = set()
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                sets = gram_sets(texts[lo:hi], n, levels.value)
                prints = [_fingerprint(s, seed) for s in sets]
                heads = []
                for s, (f1, _) in zip(sets, prints, strict=True):
                    heads.append(s[:prefix_size(len(s), percent)] if len(s) and f1 not in sent else s[:0])
                    sent.add(f1)
                offsets = np.cumsum([0, *map(len, heads)])
                keys = np.concatenate(heads).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys))],
                    names=["doc_id", "sig", "n", "f1", "f2", "head"])
    return scan


def _fetch(levels, wanted, n: int, seed: int):
    """Texts -> sets of those whose fingerprint is in the bitmap, once for each task."""
    def scan(batches):
        import pyarrow as pa

        sent: set[int] = set()
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                found = []
                every = gram_sets(texts[lo:hi], n, levels.value)
                prints = [_fingerprint(s, seed)[0] for s in every]
                near = in_bitmap(wanted.value, np.array(prints, np.int64)).tolist()
                for s, f1, likely in zip(every, prints, near, strict=True):
                    if len(s) and likely and f1 not in sent:
                        sent.add(f1)
                        found.append((f1, s.view(np.int64)))
                for i in range(0, len(found), 500):
                    f1, sets = zip(*found[i:i + 500], strict=True)
                    offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f1, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))],
                        names=["node", "grams"])
    return scan


def _likely(bits):
    """(node, n, head) -> (node, n, gram) of the columns whose hash (a key without its level) is in the bitmap."""
    def flat(batches):
        import pyarrow as pa

        for batch in batches:
            size, grams = np.diff(batch.column(2).offsets.to_numpy()), batch.column(2).flatten().to_numpy()
            keep = np.flatnonzero(in_bitmap(bits.value, grams.view(U) << U(6)))
            row = pa.array(np.repeat(np.arange(len(size)), size)[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(grams[keep])],
                                             names=["node", "n", "gram"])
    return flat


def _flat(column):
    """Offsets and values of a column of lists that may come in several chunks."""
    import pyarrow as pa

    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.flatten().to_numpy()


def _overlap(column, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many values the lists of each row of ``p`` share with those of each row of ``q`` (two equal or two disjoint masks)."""
    size, flat = _flat(column)
    row = np.repeat(np.arange(len(p)), size)
    values, at = np.unique(flat, return_inverse=True)
    shared, other = np.zeros(len(values), bool), np.zeros(len(values), bool)
    shared[at[p[row]]] = True
    other[at[q[row]]] = True
    shared &= other
    kept = shared[at]
    row, at = row[kept], (np.cumsum(shared) - 1)[at[kept]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    width, whole = int(shared.sum()), np.array_equal(p, q)
    total = np.zeros((int(p.sum()), int(q.sum())), np.float32)
    for lo in range(0, width, 4096):                               # blocks of columns
        first, last = np.searchsorted(at, [lo, lo + 4096])
        dense = np.zeros((len(p), min(4096, width - lo)), np.float32)
        dense[row[first:last], at[first:last] - lo] = 1
        total += dense @ dense.T if whole else dense[p] @ dense[q].T
    return total


def _forest(links: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (row, column) that connect whatever the whole matrix connects, fewer than its rows and columns."""
    rows, columns = [], []
    new_row, new_column = np.ones(links.shape[0], bool), links.any(axis=0)
    for start in np.flatnonzero(links.any(axis=1)).tolist():
        if not new_row[start]:
            continue
        new_row[start], stack = False, [start]
        while stack:
            a = stack.pop()
            found = np.flatnonzero(links[a] & new_column)
            new_column[found] = False
            for b in found.tolist():
                rows.append(a)
                columns.append(b)
                more = np.flatnonzero(links[:, b] & new_row)
                new_row[more] = False
                rows.extend(more.tolist())
                columns.extend([b] * len(more))
                stack.extend(more.tolist())
    return rows, columns


def _product(percent: int, gives: str):
    """Rows p and q of a pair of blocks -> (a, b, null) for a forest of their links; also (a, null, n) for the number of
    documents that a row links with (``gives`` = "counts"); or, "pairs", every link.  A pair that has a lesser block in common is left to that one."""
    def multiply(table):
        import pyarrow as pa

        node = table.column("node").to_numpy()
        p, q = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in "pq")
        size = _flat(table.column("grams"))[0].astype(np.int64)
        links = (100 + percent) * _overlap(table.column("grams"), p, q).astype(np.int64) >= percent * (size[p][:, None] + size[q])
        whole = np.array_equal(p, q)
        if whole:
            np.fill_diagonal(links, False)
        if gives != "forest":
            links &= _overlap(table.column("lesser"), p, q) == 0
        mine, other = node[p], node[q]
        if gives == "pairs":
            a, b = np.nonzero(np.triu(links) if whole else links)
            a, b = mine[a], other[b]
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": pa.nulls(len(a), pa.int64())})
        a, b = (np.array(i, np.int64) for i in _forest(links))
        edges = pa.table({"a": mine[a], "b": other[b], "n": pa.nulls(len(a), pa.int64())})
        if gives == "forest":
            return edges
        copies = table.column("copies").to_numpy().astype(np.float64)
        at, n = mine, links @ copies[q]
        if not whole:
            at, n = np.concatenate([at, other]), np.concatenate([n, copies[p] @ links])
        linked = n > 0
        return pa.concat_tables([edges, pa.table({"a": at[linked], "b": pa.nulls(int(linked.sum()), pa.int64()), "n": n[linked].astype(np.int64)})])
    return multiply


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, as_a: str = "as_a", as_b: str = "as_b") -> DataFrame:
    """The pairs (a, b) whose whole sets link; ``as_a`` and ``as_b`` are the flags of the sets that each side needs."""
    other = sets.filter(as_a).select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    mine = sets.filter(as_b).select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = pairs.select("a", "b").join(mine, "b").join(other, "a")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return both.filter((100 + percent) * overlap >= percent * (F.size("ga") + F.size("gb"))).select("a", "b")


def _candidates(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with their sets' fingerprints, rows of the matrix, pairs of sparse columns, rows of dense ones, and sets of both.

    All are written tables; those on the way to them are deleted as soon as the next is written.
    """
    spark = docs.sparkSession
    texts = pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("sig"), "text")
    levels = spark.sparkContext.broadcast(_levels(texts, n))
    for seed in range(8):
        described = shared_table(map_arrow(texts, _describe(levels, n, percent, seed),
                                           "doc_id bigint, sig bigint, n bigint, f1 bigint, f2 bigint, head array<bigint>"), "sets")
        # Rows of the matrix, one for each different set; should two sets share a fingerprint, another seed parts them.
        nodes = shared_table(described.filter("n > 0").groupBy(F.col("f1").alias("node")).agg(
            F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("f2").alias("f2"), F.max("f2").alias("g2")), "nodes")
        if nodes.filter("f2 != g2").isEmpty():
            break
        drop_tables(described, nodes)
    else:
        raise RuntimeError("sets share a fingerprint under every seed")

    # Columns with two rows or more, and their entries. (Tasks that hold copies of a row repeat its entries.)
    # Most n-grams are of one row alone: a bitmap of the columns drops them before anything is shuffled, the join the rest.
    entries = described.select(F.col("f1").alias("node"), "n", F.explode("head").alias("gram"))
    columns = shared_table(entries.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("hub"), F.max("node").alias("far"))
                           .filter("hub != far").drop("far"), "columns")
    known = spark.sparkContext.broadcast(hash_bitmap(columns.select(F.shiftleft("gram", 6).alias("gram"))))
    heads = described.filter(F.size("head") > 0).select(F.col("f1").alias("node"), "n", "head")
    entries = shared_table(map_arrow(heads, _likely(known), "node bigint, n bigint, gram bigint").join(columns, "gram"), "entries")
    drop_tables(columns)
    known.destroy()

    # A column with many rows is cut by size: a row of class c enters the blocks c and c + 1, and a pair
    # that may link is compared in the block of the greater class of the two.
    narrow = entries.filter(F.col("rows") <= DENSE).select("gram", F.lit(-1).alias("block"), "node", "n", F.lit(-1).alias("c"))
    step = -math.log(percent / 100) * (1 + 1e-9)
    wide = entries.filter(F.col("rows") > DENSE).select("gram", "node", "n", F.floor(F.log("n") / step).cast("int").alias("c"))
    both = shared_table(wide.select("gram", F.explode(F.array("c", F.col("c") + 1)).alias("block"), "node", "n", "c"), "wide")
    blocks = both.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("hub"), F.max("node").alias("far"),
                                               F.max("c").alias("top"))
    blocks = shared_table(blocks.filter("hub != far AND top = block").drop("far", "top"), "blocks")
    wide = shared_table(both.join(blocks, ["gram", "block"]), "block-entries")
    drop_tables(both, blocks)

    # Sparse columns: multiply out, add up, drop below the bound.
    thin = narrow.union(wide.filter(F.col("rows") <= DENSE).select("gram", "block", "node", "n", "c"))
    thin = thin.groupBy("gram", "block").agg(F.collect_set(F.struct("node", "n", "c")).alias("r"))
    r = F.col("r")

    def fits(x, y):
        return ((x["node"] < y["node"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
                & (F.greatest(x["c"], y["c"]) == F.col("block")))

    pairs = F.flatten(F.transform(r, lambda x: F.transform(F.filter(r, lambda y: fits(x, y)), lambda y: F.struct(
        x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))))
    counted = thin.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b", "na", "nb").agg(
        F.count(F.lit(1)).alias("overlap"))
    thick = wide.filter(F.col("rows") > DENSE)
    # Where the columns of a row end, and how many of them are dense (those are not in ``overlap``).
    ends = described.filter(F.size("head") > 0).groupBy(F.col("f1").alias("node")).agg(F.max(F.element_at("head", -1)).alias("end"))
    dense = thick.groupBy("node").agg(F.count(F.lit(1)).alias("h"))
    ends = shared_table(ends.join(dense, "node", "left").select("node", "end", F.coalesce("h", F.lit(0).cast("bigint")).alias("h")), "ends")
    counted = (counted.join(ends.select(F.col("node").alias("a"), F.col("end").alias("ea"), F.col("h").alias("ha")), "a")
               .join(ends.select(F.col("node").alias("b"), F.col("end").alias("eb"), F.col("h").alias("hb")), "b"))
    # All that two rows share up to the earlier end has been counted; beyond it that row has so many columns left.
    beyond = F.ceil(F.when(F.col("ea") <= F.col("eb"), F.col("na")).otherwise(F.col("nb")) * percent / 100) - 1
    reach = F.col("overlap") + beyond + F.least("ha", "hb")
    needed = percent * (F.col("na") + F.col("nb"))
    open_pairs = shared_table(counted.filter((100 + percent) * reach >= needed).select("a", "b"), "open-pairs")
    slim = shared_table(described.select("doc_id", "sig", "n", "f1"), "fingerprints")
    drop_tables(described, entries, ends)

    # Dense columns: rows of one hub and size make a block; the hub is one of them.
    members = shared_table(thick.select(F.xxhash64("hub", "block").alias("bucket"), "hub", "node", "n").distinct(), "members")
    drop_tables(wide)
    no, yes = F.lit(False), F.lit(True)
    wanted = (open_pairs.select(F.col("a").alias("node"), yes.alias("as_a"), no.alias("as_b"), no.alias("dense"))
              .union(open_pairs.select("b", no, yes, no)).union(members.select("node", no, no, yes)))
    wanted = shared_table(wanted.groupBy("node").agg(*[F.max(c).alias(c) for c in ("as_a", "as_b", "dense")]), "wanted")
    bits = spark.sparkContext.broadcast(hash_bitmap(wanted.select("node")))
    fetched = map_arrow(texts.select("text"), _fetch(levels, bits, n, seed), "node bigint, grams array<bigint>")
    sets = shared_table(fetched.join(wanted, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("grams", "as_a", "as_b", "dense")]), "gram-sets")
    drop_tables(wanted)
    bits.destroy()
    levels.destroy()
    return slim, nodes, open_pairs, members, sets


def link_rows(docs: DataFrame, n: int = N, percent: int = PERCENT, counted: bool = False) -> DataFrame:
    """One row per document: doc_id, sig (hash of the text), n (set size), root (of its component; null without a set), component_id.

    With ``counted`` also n_links: how many other rows link with a row, copies included.  Blocks are then multiplied
    whole, so the work, not the rows, grows with the square of the different sets that share a dense column.
    """
    return _links(docs, n, percent, counted)[0]


def _links(docs: DataFrame, n: int, percent: int, counted: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``link_rows``, and the written tables they are read from."""
    described, nodes, open_pairs, members, sets = _candidates(docs, n, percent)
    direct = shared_table(_verified(open_pairs, sets, percent), "direct-links")
    drop_tables(open_pairs)
    if counted:
        whole = _whole(members, nodes)
        products, sizes = _dense_links(whole, sets, percent, "counts")
        found = shared_table(products, "block-links")
        drop_tables(whole, sizes)
        used = [found]
        edges = direct.union(found.filter("b IS NOT NULL").select("a", "b"))
    else:
        rows = members.filter("node != hub")
        to_hub = shared_table(_verified(rows.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, percent, "dense", "dense"),
                              "hub-links")
        apart = rows.join(to_hub.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(False).alias("known")), ["hub", "node"], "left")
        apart = shared_table(apart.select("bucket", "node", "n", F.col("known").isNull().alias("left")), "apart")
        products, sizes = _dense_links(apart, sets, percent, "forest")
        used = [to_hub, apart, sizes]
        edges = direct.union(to_hub).union(products.select("a", "b"))

    roots = components(edges)
    drop_tables(sets)
    named = nodes.select("node", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = shared_table(named, "named")
    least = shared_table(named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("docs"))
                         .filter("docs > 1"), "least-ids")
    groups = named.join(least, "root").select(F.col("node").alias("f1"), "root", "component_id", "copies")
    if counted:
        alone, blocks = _alone(direct, members)
        used.append(blocks)
        alone = alone.join(nodes.select(F.col("node").alias("b"), "copies"), "b").select("a", F.col("copies").alias("n"))
        others = found.filter("n IS NOT NULL").select("a", "n").union(alone).groupBy("a").agg(F.sum("n").alias("others"))
        groups = groups.join(others, F.col("f1") == F.col("a"), "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    groups = shared_table(groups.drop("copies", "a", "others"), "groups")
    drop_tables(nodes, direct, members, roots, named, least, *used)
    # Only groups of two and more come back; any other row is its own component.
    with_set = F.col("n") > 0
    more = [F.when(with_set, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links")] if counted else []
    linked = described.join(groups, "f1", "left").select(
        "doc_id", "sig", "n", F.when(with_set, F.col("root")).alias("root"),
        F.when(with_set & F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)
    return linked, [described, groups]


def _whole(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """All rows of the dense blocks, with their copies and the lesser ones of the blocks that they are in."""
    blocks = members.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    rows = members.select("bucket", "node", "n").join(blocks, "node").join(nodes.select("node", "copies"), "node")
    lesser = F.filter("buckets", lambda x: x < F.col("bucket"))
    return shared_table(rows.select("bucket", "node", "n", F.lit(True).alias("left"), "copies", lesser.alias("lesser")), "whole-blocks")


def _alone(direct: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links (a, b), both ways, of rows that have no dense block in common; the others are counted in the blocks. And a written table they need."""
    blocks = shared_table(members.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "blocks-of-rows")
    none = F.array().cast("array<bigint>")
    pairs = (direct.join(blocks.select(F.col("node").alias("a"), F.col("buckets").alias("x")), "a", "left")
             .join(blocks.select(F.col("node").alias("b"), F.col("buckets").alias("y")), "b", "left"))
    pairs = pairs.filter(~F.arrays_overlap(F.coalesce("x", none), F.coalesce("y", none))).select("a", "b")
    return pairs.union(pairs.select("b", "a")), blocks


def all_links(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, sig, n_shingles, node; every link of two different sets: a, b, with a < b).

    ``node`` names the set of a document (null without a set).  Two documents link if they have one node or
    their nodes are a pair.  The pairs grow with the square of a group's different sets; ``link_rows`` counts them without giving them.
    """
    described, nodes, open_pairs, members, sets = _candidates(docs, n, percent)
    pairs, blocks = _alone(_verified(open_pairs, sets, percent), members)
    whole = _whole(members, nodes)
    products, sizes = _dense_links(whole, sets, percent, "pairs")
    pairs = shared_table(pairs.filter("a < b").union(products.select("a", "b")), "all-links")
    drop_tables(nodes, open_pairs, members, sets, whole, blocks, sizes)
    return described.select("doc_id", "sig", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("f1")).alias("node")), pairs


def _dense_links(rows: DataFrame, sets: DataFrame, percent: int, gives: str) -> tuple[DataFrame, DataFrame]:
    """What ``_product`` gives of the links of a bucket's left rows with any row of it, in products of bounded blocks; and a written table it needs."""
    left = F.col("left")
    sizes = rows.groupBy("bucket").agg(F.count_if(left).alias("l"), F.count_if(~left).alias("r"), F.sum(F.when(left, F.col("n"))).alias("ln"),
                                       F.coalesce(F.sum(F.when(~left, F.col("n"))), F.lit(0)).alias("rn")).filter("l > 0")
    sizes = shared_table(sizes.select("bucket", F.ceil(F.greatest(F.col("l") / BLOCK, F.col("ln") / BLOCK_GRAMS)).alias("bl"),
                                      F.ceil(F.greatest(F.col("r") / BLOCK, F.col("rn") / BLOCK_GRAMS)).alias("br")), "block-sizes")
    placed = rows.join(sizes, "bucket").withColumn("i", F.pmod(F.xxhash64("node"), F.when(left, F.col("bl")).otherwise(F.col("br"))))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("bl") - 1)
    other = F.when(F.col("br") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("br") - 1)).otherwise(F.array().cast("array<bigint>"))
    i = F.col("i")

    def product(ll, x, y, p, q):
        return F.struct(F.lit(ll).alias("ll"), x.alias("x"), y.alias("y"), p.alias("p"), q.alias("q"))

    rows_left = F.concat(F.transform(every, lambda j: product(True, F.least(i, j), F.greatest(i, j), i <= j, i >= j)),
                         F.transform(other, lambda j: product(False, i, j, F.lit(True), F.lit(False))))
    rows_right = F.transform(every, lambda j: product(False, j, i, F.lit(False), F.lit(True)))
    more = [c for c in ("copies", "lesser") if c in rows.columns]
    spread = placed.select("bucket", "node", *more, F.explode(F.when(left, rows_left).otherwise(rows_right)).alias("k"))
    blocks = spread.select("bucket", "node", *more, "k.*").join(sets.filter("dense").select("node", "grams"), "node")
    return blocks.groupBy("bucket", "ll", "x", "y").applyInArrow(_product(percent, gives), "a bigint, b bigint, n bigint"), sizes


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) and n_links (other rows it links with) of every row."""
    return link_rows(docs, n, percent, counted=True).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the least id (then hash of the text) stays.

    Links are those of ``STAGE_N`` words and ``STAGE_PERCENT``, wider than the query's.  Rows without words stay; of rows that are equal in id and text one stays.
    """
    rows = Carried(docs)
    links, used = _links(docs, STAGE_N, STAGE_PERCENT)
    every = shared_table(links, "linked")
    drop_tables(*used)
    linked = every.filter("root IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "sig")
    kept = shared_table(linked.groupBy("root").agg(F.min(rank).alias("kept")), "kept")
    judged = linked.join(kept, "root").groupBy("doc_id", "sig").agg(F.max(rank == F.col("kept")).alias("stays"), F.count(F.lit(1)).alias("same"))
    judged = shared_table(judged.filter(~F.col("stays") | (F.col("same") > 1)).select(
        F.col("doc_id").alias("_id"), F.col("sig").alias("_sig"), "stays"), "judged")
    drop_tables(every, kept)
    frame = rows.frame.withColumn("_key", F.xxhash64(rows.col("text").cast("string")))
    same = rows.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_sig"))
    # Nearly all rows that no verdict concerns are told by a bitmap: their texts are not shuffled.
    likely = likely_in(judged.select(F.xxhash64("_id", "_sig")))(F.xxhash64(rows.col("doc_id").cast("bigint"), F.col("_key")))
    some = frame.filter(likely)
    alone = frame.filter(~likely).unionByName(some.join(judged, same, "left_anti"))
    repeated = some.join(judged.filter("stays"), same, "left_semi").dropDuplicates([f"_c{rows.names.index('doc_id')}", "_key"])
    return rows.back(alone.unionByName(repeated))
