"""Removal of text that repeats across or within documents, sentence by sentence.

A unit is a run of words of one line that ends with a word ending in ``.``, ``!`` or ``?``, or with
the line; so a passage is found wherever it stands in a line, but for the sentences at its
two ends that it only shares in part.

1. Every unit is normalised (A-Z lowered, white space collapsed) and hashed to 96 bits where
   the text is read; only (document, unit, offsets, hash) rows move.
2. Hashes are counted with a partial aggregation of hashes alone.  Units whose hash occurs once
   go no further: nearly all are dropped by a broadcast bitmap of the hashes that repeat before
   anything of them moves, the rest by the join with these hashes.  For the others the earliest unit
   is found: documents rank by id, units by position.
3. All later units are repeats.  Repeated units that follow one another make a run; runs of
   at least ``MIN_RUN_WORDS`` words are removed, shorter ones (a heading, a greeting) stay.
   Removed spans keep their character offsets in the original text.

A unit that a third of all rows share is one row for each task in the counts and in the search of
the earliest; in the joins back to its units it is a skewed key that Spark splits, as both sides
are shuffled tables.

Defined cases: null or empty text and blank lines have no unit; rows with a null id rank last;
rows that are equal in id and text are one document, with one decision for all; ties of
equal ids with other texts rank by a hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import Carried, drop_tables, hash_bitmap, in_bitmap, likely_in, map_arrow, pick, shared_table
from pathweave.llm.textscan import Sentences, chunks

MIN_RUN_WORDS = 20            # of a run that is removed
_UNIT = "doc_id bigint, sig bigint, unit int, start int, stop int, n_words int, h1 bigint, h2 int"


def _units(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        for lo, hi in chunks(texts):
            found = Sentences(texts[lo:hi])
            at = pa.array(found.doc + lo)
            numbers = [x.astype(np.int32) for x in (found.number, found.starts, found.stops, found.n_words)]
            hashes = [found.hash1.view(np.int64), (found.hash2 >> np.uint64(32)).astype(np.uint32).view(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, [*numbers, *hashes])],
                                             names=["doc_id", "sig", "unit", "start", "stop", "n_words", "h1", "h2"])


def _likely(bits):
    """Units whose hash is in the bitmap."""
    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column("h1").to_numpy())))
    return keep


def _later(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every unit that repeats an earlier one, with the number of its run (``island``) in the document; and the written tables it is read from."""
    texts = pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("sig"), "text")
    units = shared_table(map_arrow(texts, _units, _UNIT), "units")
    often = shared_table(units.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"), "repeated-hashes")
    bits = docs.sparkSession.sparkContext.broadcast(hash_bitmap(often.select("h1")))
    repeated = shared_table(map_arrow(units, _likely(bits), _UNIT).join(often, ["h1", "h2"]), "repeated-units")
    drop_tables(units, often)
    bits.destroy()
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "sig", "unit")
    firsts = shared_table(repeated.groupBy("h1", "h2").agg(F.min(rank).alias("first")), "first-units")
    later = repeated.join(firsts, ["h1", "h2"]).filter(rank != F.col("first")).select(
        "doc_id", "sig", *[F.col(c).cast("bigint").alias(c) for c in ("unit", "start", "stop", "n_words")],
        F.col("first.doc_id").alias("first_doc_id")).distinct()
    island = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "sig").orderBy("unit"))
    return later.withColumn("island", island), [repeated, firsts]


def repeated_units(docs: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """One row per later unit, whatever its run: doc_id, sig, unit, start, stop, n_words, first_doc_id, run_words, removed.

    ``removed`` says whether ``repeated_runs`` with the same floor has the unit in one of its runs.
    """
    run = Window.partitionBy("doc_id", "sig", "island")
    return _later(docs)[0].withColumn("run_words", F.sum("n_words").over(run)).withColumn(
        "removed", F.col("run_words") >= min_run_words).drop("island")


def repeated_runs(docs: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """One row per removed span: doc_id, sig (hash of the text), start, stop (characters), n_units, n_words, first_doc_id.

    ``first_doc_id`` is the document that keeps the longest unit of the run.
    """
    return _runs(_later(docs)[0], min_run_words)


def _runs(later: DataFrame, min_run_words: int) -> DataFrame:
    longest = F.struct("n_words", -F.col("unit"))
    runs = later.groupBy("doc_id", "sig", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_units"),
        F.sum("n_words").alias("n_words"), F.max_by("first_doc_id", longest).alias("first_doc_id"))
    return runs.filter(F.col("n_words") >= min_run_words).drop("island")


def remove_repeats(spark, docs: DataFrame, sf_dir: str, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """Pipeline stage: repeated runs are cut out of the texts; documents of which no word is left go.

    A cut takes the white space after the run, one character, or that before it at the end of the text.
    Documents without repeats stay as they are.  ``n_chars``, if there is one, follows the text.
    """
    rows = Carried(docs)
    text = rows.col("text")
    later, tables = _later(docs)
    runs = _runs(later, min_run_words).groupBy("doc_id", "sig").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_runs"))
    runs = shared_table(runs.select(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig"), "_runs"), "runs")
    drop_tables(*tables)
    # Texts move only to meet their runs; nearly all texts without runs are told by a bitmap.
    sig = F.xxhash64(text.cast("string"))
    likely = likely_in(runs.select(F.xxhash64("_id", "_sig")))(F.xxhash64(rows.col("doc_id").cast("bigint"), sig))
    some = rows.frame.filter(likely).join(runs, rows.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (sig == F.col("_sig")), "left")
    whole = rows.frame.filter(~likely).withColumn("_runs", F.lit(None).cast(runs.schema["_runs"].dataType))
    joined = some.drop("_id", "_sig").unionByName(whole)
    size, cut = F.length(text), F.col("_runs")
    # What stays lies between the end of one run and the start of the next.
    begin = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cut, lambda r: r["stop"] + 1))
    end = F.concat(F.transform(cut, lambda r: r["start"]), F.array((size + 1).cast("bigint")))
    pieces = F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda p: F.substr(
        text, (p["b"] + 1).cast("int"), F.greatest(p["e"] - p["b"], F.lit(0)).cast("int")))
    left = F.array_join(pieces, "")
    last = F.element_at(cut, -1)["stop"] >= size
    left = F.when(last & left.rlike(r"[\x20\x09-\x0D]\z"), F.substr(left, F.lit(1), F.length(left) - 1)).otherwise(left)
    done = joined.withColumn("_left", F.when(cut.isNull(), text).otherwise(left))
    done = done.filter(cut.isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(cut.isNull(), rows.col("n_chars") if "n_chars" in rows.names else F.lit(0)).otherwise(F.length("_left"))
    return rows.back(done, text=F.col("_left"), n_chars=n_chars)
