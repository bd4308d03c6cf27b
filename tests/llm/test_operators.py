"""Each corpus operator on the small test tables, against brute force or the named library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from pathweave.llm import (bpe_codec, crf_quality, decontaminate, license_scan, ngram_join, quality_rules, queries, sharding,
                           substring_dedup, token_counts)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name, sf=SF):
    return queries.queries()[name](spark, sf)


def test_substring_dedup(spark, texts):
    got = {tuple(r) for r in run(spark, "op1_substring_dedup").select("doc_id", "start", "stop", "n_units", "n_words", "first_doc_id").collect()}
    assert got and got == brute.repeats(texts, substring_dedup.MIN_RUN_WORDS)


def test_every_later_unit_is_found(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    units = substring_dedup.repeated_units(docs).collect()
    runs = brute.repeats(texts, 1)
    assert sum(r.n_words for r in units) == sum(x[4] for x in runs) and len(units) == sum(x[3] for x in runs)
    whole = {(i, a, b): n for i, a, b, _, n, _ in runs}
    for r in units:
        n = next(n for (i, a, b), n in whole.items() if i == r.doc_id and a <= r.start and r.stop <= b)
        assert r.run_words == n and r.removed == (n >= substring_dedup.MIN_RUN_WORDS)
    assert {r.removed for r in units} == {True, False}


def test_removed_runs_leave_the_rest(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.remove_repeats(spark, docs, SF, 10).collect()}
    spans = {}
    for i, a, b, *_ in brute.repeats(texts, 10):
        spans.setdefault(i, []).append((a, b))
    want = {i: brute.cut(t, spans[i]) if i in spans else t for i, t in texts}
    want = {i: (t, len(t)) for i, t in want.items() if t is not None}
    assert spans and got == want


def test_passages_inside_lines_are_cut_where_they_stand(spark):
    passage = "This stands in many texts, word for word. It has a second sentence! And a third one of some more words? Yes, and a last."
    rows = [(1, f"Start of one. {passage} End of one."), (2, f"Another text begins here {passage} and goes on"), (3, f"Own line.\n{passage}\nLast."),
            (4, f"{passage}"), (5, f"é é.  {passage}  tail"), (6, f"x. y. {passage} "), (7, "This stands alone. It is not repeated! Yes."), (8, None), (9, "Dr. A.\tB")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {tuple(r) for r in substring_dedup.repeated_runs(docs, 12).drop("sig").collect()}
    assert got == brute.repeats([(i, t or "") for i, t in rows], 12) and {g[0] for g in got} == {2, 3, 4, 5, 6}
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark, docs, SF, 12).collect()}
    assert left[3] == "Own line.\nLast." and left[6] == "x. y. " and 4 not in left and left[5] == "é é.   tail" and left[8] is None
    assert left[2] == "Another text begins here This stands in many texts, word for word. and goes on"


@pytest.mark.parametrize("frequent", [0, 300, 10 ** 6])
def test_token_counts(spark, texts, frequent):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["", " ", "  two", "a\n\n b", "it's <|endoftext|> here", "日本 ́語", "x" * 3000, "the " * 500, "\tTab  end "]
    rows = texts + [(10_000 + i, t) for i, t in enumerate(odd)] + [(20_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    library = Tokenizer.from_file(path)
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted(map(tuple, token_counts.token_counts(df, path, frequent).collect())) == want


def test_long_pretokens_are_not_broadcast(spark):
    pieces = spark.createDataFrame([("short", 9, 1), ("x" * 64, 1, 8), ("x" * 65, 1000, 9), ("é" * 40, 5, 40)], "piece string, times bigint, pieces bigint")
    hot, known = token_counts._known(pieces, 10 ** 6)
    assert known == {"short": 1, "x" * 64: 8} and {r.piece for r in pieces.filter(~hot).collect()} == {"x" * 65, "é" * 40}


def test_bpe_codec_equals_the_library(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["", "ΣΑΣ", "it's <|startoftext|>go<|endoftext|>", "日本語 mixed", "a" * 2000, "é é", "Ᲊ Ɤ"]
    rows = texts + [(10_000 + i, t) for i, t in enumerate(odd)] + [(20_000, None)]
    library = Tokenizer.from_file(path)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = bpe_codec.encode_documents(df, path, with_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_heap_and_rank_array_agree():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        codec = bpe_codec.WordCodec(f.read())
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"aeinorst"), rng.integers(1, 60)).tolist()) for _ in range(300)]
    assert codec.merge(words) == [codec._heap([*[codec.inner[b] for b in w[:-1]], codec.last[w[-1]]]) for w in words]


def test_quality_rules(spark, texts):
    got = {r.doc_id: r.asDict() for r in run(spark, "op4_quality_rules").collect()}
    for i, t in texts:
        want = brute.measures(t)
        assert {k: got[i][k] for k in want} == want
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_a_bad_host_is_rejected_and_a_small_one_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "### $$$ %%% &&&"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "foul") for i in range(200)]
    rows += [(2000 + i, bad if i % 25 == 0 else good, f"h{i % 20}") for i in range(400)] + [(3000, bad, "tiny"), (3001, good, "tiny")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, source string, n bigint")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    assert not any(got[1000 + i].kept for i in range(200)) and not got[1000].rule_failed
    assert got[3001].kept and not got[3000].kept and got[3001].host_rate < 0.5
    assert all(got[i].kept for i in range(200))
    kept = quality_rules.keep_good(spark, df, SF)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_license_scan(spark, texts):
    rows = texts + [(10_000, "CC BY cc-by. ALL rights   reserved all rights"), (10_001, "general public license " * 3),
                    (10_002, "x Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and "
                             "associated documentation files to deal in the Software without restriction, including without limitation "
                             "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
                             "and to permit persons to whom the Software is furnished to do so y"), (10_003, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in license_scan.license_labels(df).collect()}
    for i, t in rows:
        n, starts, labels = brute.phrases(t, license_scan.BASE_PHRASES)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | set()
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert got[10_002].labels == "mit" and 0.8 <= got[10_002].score < 1


def altered_notices():
    """(text, label, whether it is still that notice): a word put in or replaced at every place of every notice."""
    for text, label, *needed in license_scan.NOTICES:
        words = brute.terms(text)
        need = " ".join(needed).split()
        yield "x " + text + " y", label, True
        for i in range(1, len(words)):
            yield " ".join([*words[:i], "zzz", *words[i:]]), label, True
        for i, w in enumerate(words):
            yield " ".join([*words[:i], "zzz", *words[i + 1:]]), label, w not in need


def in_order(a, b):
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(row[j], best[j + 1], best[j] + (x == y)))
        best = row
    return best[-1]


def test_altered_notices(spark):
    rows = [(i, *r) for i, r in enumerate(altered_notices())]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in license_scan.license_labels(df).collect()}
    for i, text, label, still in rows:
        found = set(got[i].labels.split(",")) - {"", *got[i].base_labels.split(",")}
        assert found == ({label} if still else set()), text


@pytest.mark.parametrize("broadcast", [True, False])
def test_license_places_against_plain_python(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(license_scan, "MAX_POSITIONS", 0)
    rng = np.random.default_rng(6)
    templates = [("a b c", "abc"), ("a b a b c", "ababc"), ("b b", "bb"), ("d", "d"), ("d c b a d a b c a", "long", "d"), ("...", "none"),
                 (" ".join("abcd"[i * i % 7 % 4] for i in range(24)), "longer")]
    rows = [(0, "a b c " * 4), (1, ""), (2, None)]
    rows += [(3 + i, " ".join("abcd"[k] for k in rng.integers(0, 4, 60))) for i in range(60)]
    rows += [(100 + i, " ".join([*"dcb"[:i], *templates[6][0].split(), "x", *templates[4][0].split()])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    docs, spans = license_scan.license_spans(df, templates, [])
    got = [(r.doc_id, r.label, r.start, r.n_span, r.score) for r in spans.join(docs, "row").collect()]
    assert [g[2:] for g in sorted(got) if g[:2] == (0, "abc")] == [(0, 3, 1.0), (3, 3, 1.0), (6, 3, 1.0), (9, 3, 1.0)]
    text = {i: brute.terms(t) for i, t in rows}
    words = {label: brute.terms(t) for t, label, *_ in templates}
    for i, label, start, n, score in got:
        assert 0.8 <= score <= 1 and n <= np.ceil(1.25 * len(words[label]))
        assert in_order(text[i][start:start + n], words[label]) >= round(score * len(words[label]))
    exact = {(i, label, at, len(p), 1.0) for i, w in text.items() for label, p in words.items() if p
             for at in range(len(w) - len(p) + 1) if w[at:at + len(p)] == p}
    assert exact <= set(got) and {"long", "longer"} <= {e[1] for e in exact}


@pytest.mark.parametrize("dense, block", [(64, 256), (3, 4)])
def test_ngram_join(spark, texts, monkeypatch, dense, block):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"t{i}" for i in range(60)]
    near = [(10_000 + k, " ".join([*base[:k], f"x{k}", *base[k + 1:]])) for k in range(30)]      # a chain of near copies
    passage = " ".join(f"p{i}" for i in range(40))
    unlike = [(20_000 + k, passage + " " + " ".join(f"q{k}_{i}" for i in range(12))) for k in range(25)]
    rows = texts + near + unlike + [(30_000, "one two"), (30_001, "One  two"), (30_002, ""), (30_003, None), (30_004, "three")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute.components(rows)
    roots = {r.doc_id: (r.n, r.component_id) for r in ngram_join.link_rows(df).collect()}         # by hubs, without counts
    assert roots == got


@pytest.mark.parametrize("dense, block", [(64, 512), (3, 4), (3, 512)])
def test_every_link_is_found(spark, monkeypatch, dense, block):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1:]])) for k in range(80)]                # near copies of one text
    rows += [(100 + k, " ".join([*base, *(f"y{k}_{i}" for i in range(k))])) for k in range(0, 30, 3)]
    rows += [(200, " ".join(base)), (201, rows[5][1]), (202, rows[5][1]), (300, "one two"), (301, "One  two"), (302, ""), (303, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found, pairs = ngram_join.all_links(df)
    found = {r.doc_id: r for r in found.collect()}
    sets = {i: brute.shingles(t) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and
            100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    rep = {frozenset((r.a, r.b)) for r in pairs.collect()}
    assert pairs.count() == len(rep)
    assert want == {(i, j) for i in sets for j in sets if i < j and found[i].node is not None and
                    (found[i].node == found[j].node or frozenset((found[i].node, found[j].node)) in rep)}
    counted = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(df).collect()}
    assert counted == {i: sum(i in p for p in want) for i in sets}


def test_blocks_are_cut_by_grams(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 300)
    base = [f"t{i}" for i in range(70)]
    rows = [(k, " ".join([*base[:k % 70], f"x{k}", *base[k % 70 + 1:]])) for k in range(140)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sets = {i: brute.shingles(t) for i, t in rows}
    want = {i: sum(100 * len(a & b) >= 85 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()}
    assert {r.doc_id: r.n_links for r in ngram_join.near_duplicates(df).collect()} == want


def test_forest_connects_what_the_links_connect():
    rng = np.random.default_rng(3)
    for share in (0, 0.02, 0.1, 0.9):
        links = rng.random((30, 40)) < share
        rows, columns = ngram_join._forest(links)
        assert all(links[a, b] for a, b in zip(rows, columns, strict=True))
        assert len(rows) < 70

        def parts(pairs):
            root = list(range(70))
            for a, b in pairs:
                x, y = root[a], root[30 + b]
                root = [x if r == y else r for r in root]
            return {tuple(i for i in range(70) if root[i] == r) for r in root}

        assert parts(zip(rows, columns, strict=True)) == parts(np.argwhere(links).tolist())


def test_sharding(spark, texts):
    got = sorted(map(tuple, run(spark, "op8_sharding").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()))
    total, start, slots, want = sum(len((t or "").encode()) + 1 for _, t in texts), 0, [0] * 8, []
    for i, t in sorted(texts):
        data = (t or "").encode()
        s = start * 8 // total
        want.append((i, len(data) + 1, zlib.crc32(data), "bytes", s, slots[s], None))
        slots[s] += 1
        start += len(data) + 1
    assert got == want


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8


def test_equal_rows_are_written_to_their_own_shards(spark, tmp_path):
    rows = [(i, "text of some length " + str(i)) for i in range(400)] + [(200, "the same row over and over")] * 200
    sharding.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    size = [sum(len(r.text) + 1 for r in back if r.shard == s) for s in range(8)]
    assert sorted((r.doc_id, r.text) for r in back) == sorted(rows) and max(size) - min(size) < 100


def test_blocks_of_a_benchmark_are_bounded(spark):
    rows = [(1, "one item that is repeated")] * 300 + [(i, f"item {i} of the others") for i in range(2, 60)] + [(99, "long " * 100), (100, "")]
    items = spark.createDataFrame(rows, "item_id bigint, text string").repartition(3)
    parts = [[r.text for r in p.collect()] for p in decontaminate._split(
        items.distinct().withColumn("size", F.octet_length("text").cast("bigint")).filter("size > 0"), 200, 0)]
    assert sorted(t for p in parts for t in p) == sorted({t for _, t in rows if t})
    assert all(len(p) == 1 or sum(map(len, p)) <= 200 for p in parts)
    assert sum(1 for _ in decontaminate.benchmark_blocks(items, 1000)) <= 8


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 700])
def test_decontamination(spark, texts, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = spark.createDataFrame([(900, "Onesnt theaeati"), (901, None), (902, "!!"), (None, "thanedble the anea eriner")], bench.schema)
    items = bench.unionByName(short)
    found = brute.windows([tuple(r) for r in items.collect()])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n_hits = 0
    for r in decontaminate.contamination(docs, items, block).collect():
        w, hit, ids = brute.contaminated(dict(texts)[r.doc_id], found)
        assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(x for x in ids if x != "None"))
        n_hits += bool(hit)
    assert n_hits


def test_removed_leaks_leave_the_rest(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = brute.windows([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = {r.doc_id: r.text for r in decontaminate.remove_leaks(spark, docs, SF).collect()}
    want = {i: brute.without_leaks(t, found) for i, t in texts}
    assert got == {i: t for i, t in want.items() if t is not None}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    odds, trans = rng.normal(size=5).tolist(), rng.normal(size=(2, 2)).tolist()
    chain = crf_quality.Chain([], [], [], trans, 1.0, 0.0, 0.5)
    total, good = 0.0, [0.0] * 5
    for y in np.ndindex(*[2] * 5):
        p = np.exp(sum(o for o, s in zip(odds, y) if s) + sum(trans[a][b] for a, b in zip(y, y[1:])))
        total += p
        for i, s in enumerate(y):
            good[i] += p * s
    assert np.allclose(chain.marginals(odds), np.array(good) / total)


@pytest.mark.parametrize("part", [1, 2, 3, 32])
def test_gradient_equals_differences(monkeypatch, part):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3, 4, 5)), rng.integers(0, 2, (3, 1)).repeat(4, 1).astype(float)
    monkeypatch.setattr(crf_quality, "PART", part)
    w, t = rng.normal(size=5) / 3, rng.normal(size=(2, 2)) / 3

    def likelihood(w, t):
        out = 0.0
        for k in range(3):
            e = x[k] @ w

            def value(s):
                return sum(e[i] for i in range(4) if s[i]) + sum(t[a][b] for a, b in zip(s, s[1:]))

            z = np.log(sum(np.exp(value(s)) for s in np.ndindex(2, 2, 2, 2)))
            out += (value(tuple(y[k].astype(int))) - z) / 4
        return out / 3

    found = [crf_quality._chain_gradient(b, w, t) for b in crf_quality._blocks([(int(y[k, 0]), x[k]) for k in range(3)])]
    gw, gt = (sum(f[i] for f in found) / 3 for i in (0, 1))
    for i in range(5):
        d = np.eye(5)[i] * 1e-5
        assert abs((likelihood(w + d, t) - likelihood(w - d, t)) / 2e-5 - gw[i]) < 1e-6
    for a in range(2):
        for b in range(2):
            d = np.zeros((2, 2))
            d[a, b] = 1e-5
            assert abs((likelihood(w, t + d) - likelihood(w, t - d)) / 2e-5 - gt[a, b]) < 1e-6


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in run(spark, "op10_quality_crf", sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(got[i].score, got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([p == y for _, p, y in held]) > 0.95


def test_long_chains_are_whole(monkeypatch):
    rng = np.random.default_rng(5)
    chains = [(int(k % 2), rng.normal(size=(n, 3))) for k, n in enumerate([1, 2, 31, 32, 33, 64, 65, 200, 1500])]
    w, t = rng.normal(size=3), rng.normal(size=(2, 2))
    found = []
    for part in (32, 7, 2000):
        monkeypatch.setattr(crf_quality, "PART", part)
        found.append([sum(g) for g in zip(*(crf_quality._chain_gradient(b, w, t) for b in crf_quality._blocks(chains)), strict=True)])
    for gw, gt in found[:2]:
        assert np.allclose(gw, found[2][0], atol=1e-9) and np.allclose(gt, found[2][1], atol=1e-9)


def test_rows_that_are_learned_from(spark):
    docs = spark.createDataFrame([(i, "a b\n" * (i % 7)) for i in range(300)] + [(3, "x"), (3, "x"), (9, None), (10, "z\n" * 5000)],
                                 "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    some = [(r.label, r.text) for r in crf_quality._learned(docs, labels, 100, 200).collect()]
    assert some and sum((t or "").count("\n") + 1 for _, t in some) <= 200
    every = crf_quality._learned(docs, labels, 1000, 200_000).collect()
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))
    empty = crf_quality.quality_scores(docs, labels.limit(0)).collect()
    nulls = crf_quality.quality_scores(docs, labels.withColumn("quality", F.lit(None).cast("int"))).collect()
    assert len(empty) == len(nulls) == 304 and {r.score for r in empty + nulls} == {0.5}


def test_scores_do_not_look_at_anything_but_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = {r.doc_id: r.score for r in crf_quality.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in crf_quality.quality_scores(
        docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s")}), labels.withColumn("toxic", F.lit(1))).collect()}
    assert a == b
