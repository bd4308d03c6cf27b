"""The pipeline against a brute-force version, stage by stage, and its registration."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import brute
import corpus_pipeline
from pathweave.llm import ngram_join, quality_rules, substring_dedup

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]

    def fails(t):
        m = brute.measures(t)
        return (m["base_failed"] or 100 * m["n_symbols"] > quality_rules.MAX_SYMBOL_PERCENT * m["n_words"]
                or 100 * m["n_dup_lines"] > quality_rules.MAX_DUP_LINE_PERCENT * m["n_lines"])

    failed = [(s, fails(t)) for _, t, s in docs]
    hosts = brute.good_hosts(failed)
    rows = [(i, t) for (i, t, s), (_, f) in zip(docs, failed, strict=True) if not f and s in hosts]
    group = brute.components(rows, ngram_join.STAGE_PERCENT, ngram_join.STAGE_N)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    spans = {}
    for i, a, b, *_ in brute.repeats(rows, substring_dedup.MIN_RUN_WORDS):
        spans.setdefault(i, []).append((a, b))
    rows = [(i, brute.cut(t, spans[i]) if i in spans else t) for i, t in rows]
    found = brute.windows([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [(i, brute.without_leaks(t, found)) for i, t in rows if t is not None]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        if t is not None:
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) < len(docs) and sorted(map(tuple, got)) == sorted(want)


def test_near_copies_of_five_words_and_80_percent_go(spark):
    base = [f"t{i}" for i in range(100)]
    rows = [(1, " ".join(base))]
    rows += [(10 + k, " ".join([*base, *(f"x{k}_{i}" for i in range(k))])) for k in (16, 20, 23, 24, 25, 30)]     # text appended
    rows += [(100 + k, " ".join([f"y{k}", *base[:k], f"z{k}", *base[k + 1:]])) for k in (0, 30, 50)]
    rows += [(200, "a b c d e f"), (201, "a b c d e f g"), (202, "a b c d"), (203, "A  b c d"), (204, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id for r in ngram_join.keep_one(spark, docs, SF).collect()}
    want = {i for i, (_, least) in brute.components(rows, 80, 5).items() if least == i}
    assert got == want and want != {i for i, (_, least) in brute.components(rows).items() if least == i}


def test_all_queries_are_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
