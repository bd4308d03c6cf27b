"""The corpus pipeline: from raw documents to encoded, deduplicated, clean text.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; the table of one stage is
written as Parquet and read again as the documents of the next, so a lost executor never
costs more than one stage.  All stages but the last return the columns of ``documents``.

1. quality rules: documents that the rules or their host's verdict reject go.
2. n-gram Jaccard join: of every group of near copies the document with the least id stays.
3. substring dedup: runs of lines that repeat an earlier document are cut out.
4. benchmark decontamination: passages of ``benchmark`` are cut out.
5. BPE codec: ids and checksums of the texts that are left.

Defined cases are those of the operators; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pathweave.llm.bpe_codec import bpe_stage
from pathweave.llm.decontaminate import remove_leaks
from pathweave.llm.ngram_join import keep_one
from pathweave.llm.quality_rules import keep_good
from pathweave.llm.substring_dedup import remove_repeats
from pathweave.session import shared_path

STAGES = [
    ("quality_rules", keep_good),
    ("ngram_join", keep_one),
    ("substring_dedup", remove_repeats),
    ("decontaminate", remove_leaks),
    ("bpe_codec", bpe_stage),
]

# Encoding with a tokenizer cannot be written in SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, f"pipeline/{uuid.uuid4().hex}")
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
