"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathweave.llm import bpe_codec, crf_quality, decontaminate, license_scan, ngram_join, quality_rules, sharding, substring_dedup, token_counts
from pathweave.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, size bigint, n_words bigint, "
          "_c0 string, gram string, node bigint, m string, host string, sig bigint")
LONG = "word " * 30_000 + "x" * 20_000 + " All rights reserved\n" + "line of words here and there\n" * 300
LINE = " ".join(f"unique{i}" for i in range(50))
TEXTS = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, LINE), (6, LINE), (7, LINE + "\n" + LINE), (8, "a"), (None, LINE), (None, None),
         (9, "tie " + LINE), (9, "tie " + LINE), (9, "other text with the same id"), (10, "\x00 ctl \x85 日本語 \U0001F600 é"), (11, "\n\n\n")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else "s", len(t) if t else None, k, k, k, "c", "g", k, "m", "h", k)
            for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


OPERATORS = {
    "substring_dedup": lambda d, s: substring_dedup.repeated_runs(d),
    "token_counts": lambda d, s: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "bpe_codec": lambda d, s: bpe_codec.encode_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "quality_rules": lambda d, s: quality_rules.quality_verdicts(d),
    "license_scan": lambda d, s: license_scan.license_labels(d),
    "ngram_join": lambda d, s: ngram_join.near_duplicates(d),
    "sharding": lambda d, s: sharding.assign_shards(d),
    "decontaminate": lambda d, s: decontaminate.contamination(d, s.read.parquet(f"{SF}/benchmark.parquet")),
    "crf_quality": lambda d, s: crf_quality.quality_scores(d, s.read.parquet(f"{SF}/labels.parquet")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, docs, name):
    rows = OPERATORS[name](docs, spark).collect()
    if name == "substring_dedup":
        assert {(r.doc_id, r.first_doc_id) for r in rows} == {(4, 4), (6, 5), (7, 5), (None, 5)}
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.limit(0), spark).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_that_differ_in_case(spark, docs, name):
    names = ["Text" if c == "_c0" else "DOC_ID" if c == "m" else "Source" if c == "gram" else c for c in docs.columns]
    few = docs.filter(F.col("doc_id") < 9).toDF(*names)
    assert OPERATORS[name](few, spark).count() == OPERATORS[name](docs.filter(F.col("doc_id") < 9), spark).count()


def test_groups_of_the_edge_table(spark, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    by_id = {(i, n): c for i, n, c in got}
    assert by_id[(5, 47)] == by_id[(6, 47)] == by_id[(None, 47)] == by_id[(9, 48)] == 5
    assert by_id[(1, 0)] == 1 and by_id[(2, 0)] == 2 and by_id[(None, 0)] is None and by_id[(8, 1)] == 8


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_the_edge_table(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert name == corpus_pipeline.STAGES[-1][0] or (out.columns == docs.columns and out.dtypes == docs.dtypes)
    rows = out.collect()
    if name == "ngram_join":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "10", "11", "2", "3", "4", "5", "8", "9", "None"]
        assert [r.text for r in rows if r.doc_id == 9] == ["other text with the same id"]
    elif name == "bpe_codec":
        assert len(rows) == len(TEXTS)
    elif name == "decontaminate":
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t in TEXTS)
    elif name == "substring_dedup":
        assert {str(r.doc_id) for r in rows} >= {"1", "2", "3", "5", "8", "9", "10", "11"} and all(r.text != LINE for r in rows if r.doc_id == 6)
        assert next(r.text for r in rows if r.doc_id == 4).startswith("word word")
    else:
        want = [(str(r.doc_id), r.n_words) for r in quality_rules.quality_verdicts(docs).collect() if r.kept]
        assert sorted(str(r.doc_id) for r in rows) == sorted(i for i, _ in want)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 900: 900, 901: 900, 902: 900}
    assert got == want


def test_empty_and_null_benchmark(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    null = items.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in items.schema.fields])
    for benchmark in (items.limit(0), null):
        rows = decontaminate.contamination(docs, benchmark).collect()
        assert len(rows) == len(TEXTS) and not any(r.n_hit or r.spans or r["items"] for r in rows)


@pytest.mark.parametrize("empty", [True, False])
def test_whole_pipeline_on_edge_and_empty_tables(spark, docs, tmp_path, empty):
    clean = spark.createDataFrame([(100 + k, " ".join(f"w{k}x{i}" for i in range(30)), "clean") for k in range(60)], "doc_id bigint, text string, source string")
    rows = docs.limit(0) if empty else docs.unionByName(clean, allowMissingColumns=True)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    kept = [r.doc_id for r in quality_rules.keep_good(spark, rows, str(tmp_path)).collect()]
    assert set(got) <= set(kept) and set(got) >= (set() if empty else set(range(100, 160))) and (got or empty)
