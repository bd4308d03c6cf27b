"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured in one pass over its text (no shuffle of texts): words,
word characters, symbols, repeated lines and words in repeated five-word windows.
Document rules compare these measures with limits.  A host (the ``source`` column) is
then judged as a whole: its failures and documents are counted with a partial
aggregation, the failure rate is shrunk towards the corpus with a beta prior whose
two parameters are fitted to the hosts' rates by moments (empirical Bayes), and a host
whose shrunk rate is above ``HOST_LIMIT`` is rejected with all its documents.  Small
hosts stay near the corpus rate, so a few bad pages do not condemn them.  Verdicts are
joined back to the documents; the host table is written first, so Spark broadcasts it
only if its size on disk is below the session's limit and else runs a skew-aware join.

A document is kept if it passes the base rules, the document rules and its host does.

Defined cases: null or empty text has no words and fails the base rule (too few
words); a null source is a host of its own; repeated rows are judged one by one; with one
host, or hosts that differ no more than chance, the prior is worth ``PRIOR_MAX``
documents at the corpus rate; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.timefns import let
from pathweave.llm.common import Carried, pick, shared_table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20      # words in repeated windows
MAX_SYMBOL_PERCENT = 50      # symbols against words
MAX_DUP_LINE_PERCENT = 50    # repeated lines against lines that have a word
HOST_LIMIT = 0.5             # shrunk failure rate
PRIOR_MIN, PRIOR_MAX = 2.0, 10_000.0

_SPACES = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"


def measures(text: Column) -> Column:
    """One expression for all measures of a text (a struct); every intermediate value is bound once.

    A filter on it may be pushed to the scan without computing anything twice.
    """
    no_numbers = F.array().cast("array<bigint>")

    def repeated_words(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda p: let(
            F.sort_array(F.transform(F.filter(p, lambda e, i: (e["h"] == F.get(p, i - 1)["h"]) | (e["h"] == F.get(p, i + 1)["h"])),
                                     lambda e: e["i"])),
            # Each window of five counts up to the start of the next repeated window.
            lambda starts: F.aggregate(
                F.transform(starts, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW)))),
                F.lit(0).cast("bigint"), lambda a, x: a + x)))

    def windows_of(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda codes: F.when(
            F.size(codes) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(codes) - WINDOW),
                        lambda i: F.xxhash64(*[F.get(codes, i + j) for j in range(WINDOW)]))).otherwise(no_numbers))

    def lines_of(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: x.rlike(_WORD))

    def struct(t: Column, body: Column, words: Column) -> Column:
        return let(windows_of(words), lambda windows: let(lines_of(t), lambda lines: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct(windows)) < F.size(windows), repeated_words(windows))
            .otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"))))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.trim(t, F.lit(_SPACES)), lambda body: let(
        F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+")),
        lambda words: struct(t, body, words))))


def document_measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the measures of every row; nothing is shuffled."""
    df = pick(docs, doc_id="bigint", text="string", source="string")
    return df.select("doc_id", F.col("source").alias("host"), measures(F.col("text")).alias("m")).select("doc_id", "host", "m.*")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rule_failed(m: Column) -> Column:
    return (base_failed(m) | (100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * m["n_words"])
            | (100 * m["n_dup_lines"] > MAX_DUP_LINE_PERCENT * m["n_lines"]))


def with_document_rules(measured: DataFrame) -> DataFrame:
    m = F.struct("n_words", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return measured.withColumn("base_failed", base_failed(m)).withColumn("rule_failed", rule_failed(m))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, host_docs, host_failures, host_rate (shrunk) and host_ok: one row per host."""
    c = F.col
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"),
                                       F.sum(c("rule_failed").cast("bigint")).alias("host_failures"))
    hosts = shared_table(hosts, "hosts")
    # Moments over hosts: the corpus rate m, and the part of the hosts' variance that chance does not explain.
    k = F.count(F.lit(1)).cast("double")
    n, n2 = F.sum("host_docs").cast("double"), F.sum(c("host_docs").cast("double") * c("host_docs"))
    m = F.sum("host_failures") / n
    squares = F.sum(c("host_failures").cast("double") * c("host_failures") / c("host_docs"))
    fitted = hosts.agg(k.alias("k"), n.alias("n"), n2.alias("n2"), m.alias("m"), squares.alias("sq"))
    between = (c("sq") - c("n") * c("m") * c("m") - (c("k") - 1) * c("m") * (1 - c("m"))) / (c("n") - c("n2") / c("n"))
    strength = F.when((c("k") > 1) & (between > 0), c("m") * (1 - c("m")) / between - 1).otherwise(F.lit(PRIOR_MAX))
    strength = F.greatest(F.lit(PRIOR_MIN), F.least(F.lit(PRIOR_MAX), strength))
    prior = fitted.select((c("m") * strength).alias("alpha"), ((1 - c("m")) * strength).alias("beta"))
    rate = (c("host_failures") + c("alpha")) / (c("host_docs") + c("alpha") + c("beta"))
    return hosts.join(F.broadcast(prior)).select(             # one row of two numbers
        "host", "host_docs", "host_failures", rate.alias("host_rate"), (rate <= HOST_LIMIT).alias("host_ok"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: the measures, base_failed, rule_failed, the host's figures and kept."""
    # The measures are written once (no texts): the host counts and the verdict join both read them.
    judged = with_document_rules(shared_table(document_measures(docs), "measures"))
    hosts = shared_table(host_verdicts(judged), "verdicts").withColumnRenamed("host", "_host")
    joined = judged.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("rule_failed") & F.col("host_ok"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with the columns of ``docs``.

    Only measures are written and joined; texts are filtered where they are read.
    """
    hosts = host_verdicts(with_document_rules(shared_table(document_measures(docs), "measures")))
    bad = shared_table(hosts.filter(~F.col("host_ok")).select(F.col("host").alias("_host")), "bad-hosts")
    rows = Carried(docs)
    good = rows.frame.filter(~let(measures(rows.col("text").cast("string")), rule_failed))
    return rows.back(good.join(bad, rows.col("source").eqNullSafe(F.col("_host")), "left_anti"))
