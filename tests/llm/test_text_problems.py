"""Pages, budgets, encoding, leaks and abuse on small fixtures, with dirty rows."""

import datetime
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import abuse_text, bpe, p1_pages, p2_budget, p6_encoding, p7_leaks, p8_abuse, page_labels, page_text

needs_vocabulary = pytest.mark.skipif(not Path(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary files here")
DOC = "doc_id long, id string, source_id string, source string, path string, lang string, text string, raw_content string, created_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def documents(spark, *rows):
    """Rows of (doc_id, path, text) with text also as raw_content, plus columns whose names clash with the operators' own."""
    full = [(i, f"d{i}", "s1", "s", path, "en", text, text, T0) for i, path, text in rows]
    df = spark.createDataFrame(full, DOC)
    for name in ("doc_key", "ids", "score", "known", "piece", "label", "features", "item_id", "n", "y", "reasons", "line"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# problem 1


def test_tree_uses_words_densities_and_neighbours(spark):
    tree, anchors = p1_pages.trained(spark)
    blocks = [(label, f) for text, labels in page_labels.labelled_pages() for label, f in zip(labels, page_text.page_features(text, anchors)[1], strict=True)]
    wrong = sum((p1_pages.leaf(tree, f) >= 0.5) != bool(label) for label, f in blocks)
    assert len(blocks) > 600 and wrong <= 0.05 * len(blocks)
    used = p1_pages.describe(tree)
    assert "\ndensity" in f"\n{used}" or " density" in used
    assert any(f"{side}_{what}" in used for side in ("prev", "next") for what in ("words", "density"))
    assert p1_pages.trained(spark)[0] is tree  # fitted once


def test_tree_holds_on_pages_left_out(spark):
    parts = p1_pages.heldout_report(spark).collect()
    n = sum(r["n_blocks"] for r in parts)
    assert sum(r["precision"] * r["n_blocks"] for r in parts) / n > 0.9 and sum(r["recall"] * r["n_blocks"] for r in parts) / n > 0.9


def test_pages_lines_and_articles(spark):
    page = "﻿Home | Docs | Login\r\n\r\n# Title\nOn this page\nPart\nText of the article, long enough to be prose.\n## Part\n- Settings\nHome | End | PgUp | PgDn\n \nPrevious   Next: Other →\n© 2024 X. All rights reserved."
    df = documents(spark, (1, "HTTPS://h.example/a", page), (2, "src/a.py", page), (3, None, page), (4, "http://h.example/b", None), (5, "http://h.example/c", " \n\t"), (6, "http://h.example/d", "x " * 200_000))
    got = {(r["doc_id"], r["line_no"]) for r in p1_pages.found(df).collect()}
    assert got >= {(1, 0), (1, 3), (1, 10), (1, 11)} and not got & {(1, 2), (1, 5), (1, 6), (1, 7)} and {k for k, _ in got} <= {1, 6}
    articles = {r["doc_id"]: r for r in p1_pages.articles(df).collect()}
    assert set(articles) == {1, 4, 5, 6}
    assert articles[1]["article"].startswith("# Title\n") and "Text of the article" in articles[1]["article"] and articles[1]["dropped"] == len([k for k, _ in got if k == 1])
    assert articles[4]["article"] == "" and articles[5]["kept"] == 0
    assert p1_pages.found(df.limit(0)).count() == 0


# problem 2


CHUNK = "id string, document_id string, source_name string, source_version string, content string, token_count int, created_at timestamp"


def test_audit_of_chunks(spark):
    day = datetime.timedelta(1)
    chunks = spark.createDataFrame(
        [
            ("ok", "d1", "lib", "1", "one two three", 4, T0),
            ("null", "d1", None, None, "one", None, T0),
            ("off", "d1", "Lib", "1 ", "", 1, T0),
            ("lost", "gone", "x", "y", "one two three", 4, T0),
            ("again", "d1", "lib", "1", "one two three", 9, T0 + day),
            ("again", "d1", "lib", "1", "one two three", 4, T0),
            ("nocontent", "d1", "lib", "1", None, 0, T0),
            (None, "d1", "lib", "1", "x", 9, T0),
        ],
        CHUNK,
    )
    docs = documents(spark, (1, "a", "t"), (2, "a", "t")).withColumn("id", F.lit("d1"))
    sources = spark.createDataFrame([("s1", "lib", "1")], "id string, name string, version string")
    got = {(r["id"], r["field_name"]) for r in p2_budget.falsifying_fields(chunks, docs, sources).collect()}
    assert got == {("null", "token_count"), ("null", "source_name"), ("null", "source_version"), ("off", "token_count"), ("off", "source_name"), ("off", "source_version"), ("again", "token_count")}
    assert p2_budget.falsifying_fields(chunks.limit(0), docs, sources).count() == 0
    assert {r["id"] for r in p2_budget.falsifying_fields(chunks, docs.limit(0), sources).collect()} == {"null", "off", "again"}


@needs_vocabulary
def test_piece_totals_equal_the_encoding(spark):
    df = documents(spark, (1, "https://A.example:80/x", "Hello wörld " * 50 + "zzzqqqjj 12345"), (1, "https://a.example/x", "Hello wörld " * 50 + "zzzqqqjj 12345"), (2, "b.md", None), (3, "c", ""), (4, "d", "q" * 3000))
    totals = {r["doc_id"]: r["n_tokens"] for r in p2_budget.document_tokens(df).collect()}
    ids = {r["doc_id"]: len(r["ids"]) for r in p6_encoding.encode_corpus(df.drop("ids")).collect()}
    assert totals == ids and totals[2] == totals[3] == 0
    assert {r["doc_id"]: r["n_tokens"] for r in p2_budget.document_tokens(df, tokenizer="words").collect()}[1] == 102 * 4 // 3
    budget = p2_budget.token_budget(df, spark.createDataFrame([("s1", "lib", "1")], "id string, name string, version string")).collect()
    assert sum(r["n_documents"] for r in budget) == 4 and {r["domain"] for r in budget} == {"a.example", None}


@pytest.mark.parametrize(("value", "expected"), [("en-US", "en"), ("German", "de"), (None, "und"), ("??", "und"), ("ZH_cn", "zh"), ("français", "fr"), ("unknown", "und")])
def test_languages(spark, value, expected):
    assert spark.createDataFrame([(value,)], "x string").select(p2_budget.clean_language(F.col("x"))).first()[0] == expected


# problem 6


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merging_equals_the_public_library(text):
    import tiktoken

    encoder = test_merging_equals_the_public_library.__dict__.setdefault("own", bpe.Encoder(bpe.load_ranks()))
    other = test_merging_equals_the_public_library.__dict__.setdefault("other", tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=encoder.ranks, special_tokens={}))
    text = text.encode("utf-8", "ignore").decode()
    ids = list(encoder.encode(text))
    assert ids == other.encode_ordinary(text)
    assert bpe.Decoder(encoder.ranks).decode(ids) == text


@needs_vocabulary
def test_encoding_rows(spark):
    df = documents(spark, (1, None, None), (2, None, ""), (3, None, "<|endoftext|>"), (4, None, "a b" * 40_000), (5, None, "same"), (5, None, "same"))
    rows = p6_encoding.encode_corpus(df).collect()
    assert df.columns and len(rows) == 6 and set(rows[0].asDict()) == {"doc_id", "ids"}
    by = {r["doc_id"]: r["ids"] for r in rows}
    assert by[1] == by[2] == [] and len(by[3]) > 1
    texts = {r["doc_id"]: r["text"] for r in p6_encoding.decode_corpus(p6_encoding.encode_corpus(df)).collect()}
    assert texts[4] == "a b" * 40_000 and texts[3] == "<|endoftext|>" and texts[1] == ""
    assert p6_encoding.roundtrip(df).where("NOT exact").count() == 0
    assert p6_encoding.encode_corpus(df.limit(0)).count() == 0


# problem 7


def made_items(n, seed=5):
    rng = np.random.default_rng(seed)
    names = [f"name{i}x" for i in range(400)]
    return {k: " ".join(rng.choice(names, 60)) + f" number {k}" for k in range(n)}


def test_leaks_against_brute_force(spark):
    items = made_items(12)
    rng = np.random.default_rng(1)
    docs, truth = [], set()
    for d in range(60):
        k = int(rng.integers(12))
        words = items[k].split()
        share = [0.0, 0.15, 0.5, 0.9][d % 4]
        begin = int(rng.integers(0, len(words) - int(share * len(words)) + 1))
        piece = words[begin : begin + int(share * len(words))]
        if d % 3 == 0 and piece:
            piece[len(piece) // 2] = "changed"
        filler = [f"other{int(x)}" for x in rng.integers(0, 500, 80)]
        docs.append((d, None, " ".join(filler[:40]) + "\n> **" + ", ".join(piece).upper() + "**\n" + " ".join(filler[40:])))
        if share >= 0.5:
            truth.add((d, k))
    table = spark.createDataFrame([(k, "s", t) for k, t in items.items()], "item_id long, suite string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in p7_leaks.found(documents(spark, *docs), table).collect()}
    assert got == truth
    for d, k in got:
        a, b = p7_leaks.words_of(items[k]), p7_leaks.words_of(docs[d][2])
        assert sum(m.size for m in SequenceMatcher(None, a, b, False).get_matching_blocks()) >= len(a) / 3
    spread = {(r["doc_id"], r["item_id"]) for r in p7_leaks.found(documents(spark, *docs).repartition(7), table.repartition(5, "text")).collect()}
    assert spread == truth


def test_leaks_edited_densely_or_in_short_pieces(spark):
    """Half an item with every 4th to 8th word edited, or in pieces of 6 to 9 words far apart, is always found."""
    items = made_items(40)
    docs, truth = [], set()
    for k, text in items.items():
        words = text.split()
        half = words[15:47]
        fillers = iter(range(100_000))
        filler = lambda n: [f"other{next(fillers)}" for _ in range(n)]  # noqa: B023, E731
        for every in (4, 5, 6, 7, 8):
            docs.append((len(docs), None, " ".join(filler(30) + [f"edit{i}" if i % every == every - 1 else w for i, w in enumerate(half)] + filler(30))))
            truth.add((len(docs) - 1, k))
        for size in (6, 7, 8, 9):
            pieces = [words[i : i + size] + filler(150) for i in range(0, 4 * size + 4, size + 1)]
            docs.append((len(docs), None, " ".join(w for piece in pieces for w in piece)))
            truth.add((len(docs) - 1, k))
    table = spark.createDataFrame([(k, "s", t) for k, t in items.items()], "item_id long, suite string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in p7_leaks.found(documents(spark, *docs), table).collect()} == truth


def test_leaks_dirty_rows(spark):
    shared = "Answer the following question with a single word please."
    items = spark.createDataFrame(
        [(1, "a", shared + " " + made_items(3)[0]), (2, "a", shared + " " + made_items(3)[1] + "\nA) 12\nB) 13"), (3, "b", None), (4, "b", ""), (5, "b", "tiny"), (1, "a", "short"), (None, "b", made_items(3)[2])],
        "item_id long, suite string, text string",
    )
    docs = documents(spark, (1, None, shared), (2, None, None), (3, None, ""), (4, None, made_items(3)[0]), (4, None, made_items(3)[0]), (5, None, "A) 12\nB) 13"), (6, None, "w " * 200_000 + made_items(3)[1]))
    assert {(r["doc_id"], r["item_id"]) for r in p7_leaks.found(docs, items).collect()} == {(4, 1), (6, 2)}
    assert p7_leaks.found(docs, items).count() == 2
    assert p7_leaks.found(docs.limit(0), items).count() == p7_leaks.found(docs, items.limit(0)).count() == 0
    report = {r["suite"]: (r["n_leaked_items"], r["n_pairs"]) for r in p7_leaks.suite_report(docs, items).collect()}
    assert report["a"] == (2, 2) and report["b"][0] == 0


def test_phrases_of_several_items_are_no_evidence(spark):
    """Phrases within sentences that several items share count neither for their carriers nor for decoys, also edited ones."""
    phrase = "explain why the lamp of the old harbour could not be used before the bell rang for the second time that night in"
    texts = {k: f"{phrase} {words}" for k, words in made_items(6).items()}
    items = spark.createDataFrame([(k, "s", t) for k, t in texts.items()], "item_id long, suite string, text string")
    docs = documents(spark, (1, None, phrase * 3), (2, None, phrase.replace("lamp", "stone") + " name1x other"), (3, None, texts[4]))
    assert {(r["doc_id"], r["item_id"]) for r in p7_leaks.found(docs, items).collect()} == {(3, 4)}


def test_long_options_long_tags_and_equal_items(spark):
    """Options and tags of any length are no words of an item; items with the same text are all reported."""
    one, two, three = made_items(3).values()
    option = " ".join(f"choice{i}" for i in range(40))
    link = f'<a href="https://example.org/{"x" * 200}">'
    items = spark.createDataFrame(
        [(1, "s", f"{one}\nA) {option}\nB) {option} again\n"), (2, "s", two), (3, "s", two.upper()), (4, "s", f"{link}{three}</a>"), (5, "s", f"1. {option} alone")], "item_id long, suite string, text string"
    )
    docs = documents(spark, (1, None, f"A) {option}"), (2, None, f"see {two}!"), (3, None, " ".join(w if i % 6 else f"{w} {link}" for i, w in enumerate(three.split()))), (4, None, f"x {one} y"))
    assert {(r["doc_id"], r["item_id"]) for r in p7_leaks.found(docs, items).collect()} == {(1, 5), (2, 2), (2, 3), (3, 4), (4, 1)}


def test_repetitions_reach_their_target():
    """Windows with the allowed edits meet in one of the repetitions about as often as asked for."""
    rng = np.random.default_rng(99)
    for width in (5, 8, 12):
        values = np.concatenate([[0], rng.integers(1, 1 << 32, 3000)]).astype(np.uint64)
        plain = rng.integers(1, 3000, (2000, width))
        edited = plain.copy()
        for row in edited:
            row[rng.permutation(width)[: p7_leaks.edits_of(width)]] = 0
        met = np.zeros(2000, bool)
        for repeat in range(p7_leaks.repetitions(width)):
            walk = p7_leaks.Walk(width, repeat)
            met |= walk.keys(plain, values) == walk.keys(edited, values)
        assert met.mean() > p7_leaks.TARGET - 0.1


# problem 8


@pytest.mark.parametrize("text", ["you i d i o t", "You ARE a m0r0n!", "you​ cr​etin", "you c****n", "you p.rick", "you sсumbаg", "yoouuu piiiig you looooser", "du Vollidiot", "eres un cabrón", "va crever, connard"])
def test_disguises_are_uncovered(text):
    reader = abuse_text.Words()
    found = [s for sentence in reader.sentences(text) for s in abuse_text.signals(sentence, *reader.words(sentence))]
    assert "#insult" in found


def test_scores_without_labels_and_dirty_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, rater string, quality int, toxic int, labelled_at timestamp")
    good = "Kill the child process before the parent aborts. The chat filter masks words such as idiot or porn. " * 20
    df = documents(spark, (1, None, good), (2, None, good + "\nYou are a worthless idiot, drop dead!"), (3, None, None), (4, None, " "), (5, None, "All Martians are vermin and should be driven out for good."), (6, None, "只有白痴才会写出这种东西，去死吧。"))
    model = p8_abuse.train(df, labels)
    scores = {r["doc_id"]: r["score"] for r in p8_abuse.score_documents(df, model).collect()}
    assert {k for k, v in scores.items() if v >= 0.5} == {2, 5, 6} and scores[3] < 0.01
    assert {r["doc_id"] for r in p8_abuse.found(df, labels).collect()} == {2, 5, 6}
    assert "worthless idiot" in p8_abuse.offending_sentences(df.where("doc_id = 2"), model).first()["sentence"]
    assert p8_abuse.found(df.limit(0), labels).count() == 0
    assert sum(r["n_offending"] for r in p8_abuse.rates(df, labels).collect()) == 3


def test_weights_are_learned_from_document_labels(spark):
    rng = np.random.default_rng(2)
    plain = ["the quiet lamp stands near the wall", "a green boat crosses the lake slowly", "seven stones lie under the old bridge"]
    rows, votes = [], []
    for i in range(400):
        lines = list(rng.choice(plain, 4))
        bad = i % 10 == 0
        if bad:
            lines.insert(int(rng.integers(4)), "those glorbish people smell of zarnak")
        rows.append((i, None, "\n".join(lines)))
        if i < 280:
            votes += [(i, "r1", None, int(bad), T0), (i, "r2", None, int(bad) if i % 9 else None, T0), (i, "r1", None, int(bad), T0)]
    docs = documents(spark, *rows)
    labels = spark.createDataFrame(votes, "doc_id long, rater string, quality int, toxic int, labelled_at timestamp")
    model = p8_abuse.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in p8_abuse.score_documents(docs.where("doc_id >= 280"), model).collect()}
    assert np.mean([(s >= 0.5) == (i % 10 == 0) for i, s in scores.items()]) > 0.95
    assert all("zarnak" in r["sentence"] for r in p8_abuse.offending_sentences(docs.where("doc_id >= 280"), model).collect())
    report = {r["model"]: r for r in p8_abuse.heldout_report(docs, labels).collect()}
    assert report["prior"]["recall"] == 0 and report["trained"]["recall"] == report["trained"]["precision"] == 1


def test_training_is_bounded_in_rows_and_bytes(spark):
    docs = documents(spark, *[(i, None, f"word{i} " * 50) for i in range(60)])
    labels = spark.createDataFrame([(i, "r", None, i % 2, T0) for i in range(60)], "doc_id long, rater string, quality int, toxic int, labelled_at timestamp")
    assert p8_abuse.labelled_features(docs, labels).num_rows == 60
    assert p8_abuse.labelled_features(docs, labels, max_labelled=20).num_rows == 20
    assert 4 <= p8_abuse.labelled_features(docs, labels, max_bytes=4000).num_rows <= 12
