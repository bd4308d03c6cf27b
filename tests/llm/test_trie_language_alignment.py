"""Prefix trie, language identification and token alignment against brute force and held-out labels."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from pathweave.llm import language_id, prefix_trie, token_alignment

SF = "/root/testdata/sf0.01"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def conversations():
    r = random.Random(7)
    rows = [(c, r.choice([t, t, t, t, None, 0]), r.choice(["user", "assistant", None, ""]), r.choice(["a b c", "a b", "x", None, "", "q w e"]))
            for c in range(-30, 150) for t in range(r.choice([0, 1, 2, 3, 4, 5, 6]))]
    rows += [(None, 1, "u", "no conversation"), (500, 3, "u", "deep")] + [(700, 0, "u", "repeated row")] * 5
    return rows + [(600 + k, i, "u", f"t {i}") for k in range(40) for i in range(60 + k // 20)]     # copies that are long


@pytest.mark.parametrize("limit", [prefix_trie.CONTAINER, 60, 1])
def test_trie_equals_brute_force_however_often_it_is_burst(spark, limit):
    rows = conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    got = prefix_trie.conversation_trie(df, limit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.trie(rows), key=str)


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = prefix_trie.conversation_trie(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.trie([tuple(r) for r in df.collect()]), key=str)


def test_trie_of_equal_conversations_writes_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(20 * k + 20, 0, "u", "same text") for k in range(50)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.trie(rows), key=str)


def test_trie_with_clashing_columns_and_without_rows(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "v", "b")]
    df = spark.createDataFrame([(*r, "x", b"y", 3, 4) for r in rows], CONVERSATIONS + ", Text string, head binary, ids bigint, key bigint")
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect()), key=str) == sorted(brute.trie(rows), key=str)
    assert prefix_trie.conversation_trie(df.limit(0)).collect() == []
    only = spark.createDataFrame([(None, 0, "u", "a")], CONVERSATIONS)
    assert prefix_trie.conversation_trie(only).collect() == []


def test_burst_rounds_follow_the_branching_not_the_length(spark):
    rows = [(c, [b"%d" % i for i in range(200)] + [b"end%d" % c], [1] * 201) for c in range(5)]
    lists = spark.createDataFrame(rows, "conv_id bigint, ids array<binary>, words array<bigint>")
    calls = []
    burst = prefix_trie._burst
    prefix_trie._burst = lambda df, limit: calls.append(1) or burst(df, limit)
    try:
        nodes = {(r.depth, r.conv_id): r for r in prefix_trie.prefix_trie(lists, 10).collect()}
    finally:
        prefix_trie._burst = burst
    assert len(calls) == 2 and len(nodes) == 201 + 5
    assert nodes[0, 0].saved_tokens == 4 * 200 and nodes[200, 0].n_children == 5 and nodes[201, 3].parent_conv_id == 0


def test_ngrams_and_letters():
    texts = ["Hello, wörld! a", "", "b2b  Привет 123", "...", " x", "日本語"]
    text, _, times, letters = language_id.grams(texts)
    for i, t in enumerate(texts):
        assert sorted(times[text == i].tolist()) == brute.letter_grams(t, language_id.ORDERS)
    assert letters.tolist() == [True, False, True, False, True, True]


def test_ngrams_do_not_depend_on_the_neighbours():
    texts = ["one two", "drei vier.", "", "cinq six ", "x"]
    text, column, times, _ = language_id.grams(texts)
    for i, t in enumerate(texts):
        _, alone, n, _ = language_id.grams([t])
        assert column[text == i].tolist() == alone.tolist() and times[text == i].tolist() == n.tolist()


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    a, b = (sorted(map(tuple, language_id.predict_languages(d.coalesce(1), 50, 100_000).collect())) for d in (docs, other))
    assert a == b


def test_language_sample_keeps_its_bounds(spark):
    rows = [("en", f"text number {i}") for i in range(500)] + [("en", "copy " * 10)] * 300 + [("de", "sehr " * 9000)] + [("de", f"kurz {i}") for i in range(90)]
    sample, langs = language_id._sample(spark.createDataFrame(rows, "lang string, text string"), 100, 20_000)
    got = sample.collect()
    assert langs == ["de", "en"] and len(got) == len({(r.lang, r.text) for r in got})
    for lang in langs:
        mine = [r.text for r in got if r.lang == lang]
        assert 0 < len(mine) <= 50 and sum(map(len, mine)) <= 10_000


def test_languages_of_edge_rows(spark):
    long = "palabra larga " * 20_000
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ...", "en"), (4, "the house and the garden", "en"), (5, "das Haus und der Garten", "de"),
            (6, "la casa y el jardín", None), (None, "the garden", "en"), (7, long, "es"), (9, long, "es"), (9, long, "es"), (11, "der Garten", "de")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, Lang string, h bigint")
    got = language_id.predict_languages(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3)) and by_id[9].lang_pred == "es"
    nothing = language_id.predict_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(rows)
    assert language_id.predict_languages(df.limit(0)).collect() == []


def test_leader_drops_columns_that_say_nothing():
    leader = language_id.Leader(3, 2)
    for i in range(400):
        leader.learn(np.array([i % 2, 2]), np.array([1.0, 1e-4]), i % 2)
    w = leader.weights()
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and not w[2].any()


def test_temperature_of_overconfident_scores():
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 4000)
    z = np.where(np.arange(2) == y[:, None], 1.0, 0.0) + r.normal(0, 1, (4000, 2))
    fair = language_id.temperature(z, y)
    assert abs(language_id.temperature(10 * z, y) / fair - 10) < 0.1


PARTS = ["hello", "world", " ", "  ", "\n", "\t", " \n ", "é", "é", "日本語", "\U0001F600\U0001F600", "▁", "<|endoftext|>",
         "</s>", "<0x41>", "x" * 50, "123", "'s", "\x00", "\x85", " ", "a", "​", "ﬁ", "I'm", "...", "\x1f", "　", "мир"]


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 20, 0])
def test_alignment_equals_both_libraries(spark, frequent):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(PARTS) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(0, 30)))) for i in range(600)]
    rows += [(9001, None), (9002, ""), (None, "null id"), (9003, " "), (9003, " "), (9004, "word " * 3000), (9005, "ab" * 20_000), (9006, "▁x")]
    df = spark.createDataFrame([(*x, 1, "y", "z") for x in rows], "doc_id bigint, text string, row bigint, pairs string, Text string").repartition(5)
    got = sorted(map(tuple, token_alignment.align_tokens(df, *FILES, frequent).collect()), key=str)
    assert got == sorted(brute.alignment(rows, *FILES), key=str)
    assert token_alignment.align_tokens(df.limit(0), *FILES).collect() == []


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, token_alignment.align_tokens(docs, *FILES).collect()))
    assert got == sorted(brute.alignment([(r.doc_id, r.text) for r in docs.collect()], *FILES))


def test_alignment_without_memory_and_with_wide_groups(monkeypatch):
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        pieces = token_alignment.Pieces(f.read(), g.read())
    texts = ["some words here and there", "x" * 300 + " words", "\U0001F600\U0001F601 a", "▁ bad", ""]
    want = [x.tolist() if hasattr(x, "tolist") else x for x in token_alignment.Book(pieces).align(texts)]
    monkeypatch.setattr(token_alignment, "BOOK_BYTES", 0)
    monkeypatch.setattr(token_alignment, "WIDE", 0)
    book = token_alignment.Book(pieces)
    for _ in range(2):
        assert [x.tolist() if hasattr(x, "tolist") else x for x in book.align(texts)] == want


def test_coalescing_breaks_where_both_sides_end():
    a, b, n = token_alignment.coalesce(np.array([2, 2, 3, 1]), np.array([1, 3, 2, 2]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1] and n == 2
