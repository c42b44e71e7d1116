"""Periodic runs, ranked search and token counts against brute force."""

import functools
import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_points
from grievaline.llm import periodic, queries, ranked, token_counts

LLM = entry_points.queries()
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "the cat sat " * 9 + "on the mat", "a"),
    (2, "THE cat  sat on\nthe mat today", "b"),
    (3, None, None),
    (4, "", "a"),
    (4, "", "a"),
    (5, " \t\n", "c"),
    (6, LONG, "d"),
    (None, "x " * 40, "e"),
    (None, "no id here", "e"),
    (7, "日本語 текст <|endoftext|> a<|endoftext|>b \x85 ½ ﬁ İstanbul ς'S", "f"),
    (8, "tick! " * 30 + "tock", "f"),
]
RESULTS = ["n_runs", "start", "length", "period", "score", "rank", "n_tokens", "n_bytes", "over_limit", "runs_sha256"]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows with columns that clash with results and helpers."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, note string")
    return frame.selectExpr(
        "*", "map('k', note) AS tags", "note AS words", "1 AS item", "2 AS box", "3 AS `read 0`", "note AS terms"
    ).repartition(3).cache()


def brute_runs(words, least=24, times=3):
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                found.setdefault((i - p, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, m, p) for (s, m), p in found.items())


def brute_row(words):
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    head = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
    return (*head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


RUNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), st.sampled_from([6, 24, 30]))
def test_runs_are_brute_force(parts, least):
    words = [w for some, times in parts for w in some * times]
    found = periodic.find_runs(np.array(words, dtype=np.int64), least)
    assert [tuple(r) for r in found.tolist()] == brute_runs(words, least)


def test_runs_of_texts_that_go_together(monkeypatch):
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 500)
    rng = random.Random(1)
    texts = [[b"%d" % rng.randrange(3) for _ in range(rng.randint(0, 40))] * rng.randint(0, 5) for _ in range(150)]
    found = periodic.runs_of_texts(texts)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(t) for t in texts]


def test_runs_of_awkward_rows(docs):
    found = periodic.periodic_runs(docs)
    assert set(docs.columns) <= set(found.columns)
    rows = found.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        words = (r["text"] or "").encode().split()
        want = brute_row(words) if len(words) < 1000 else (0, *(None,) * 4, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
        assert tuple(r[c] for c in RUNS) == want
        assert r["tags"] == {"k": r["note"]} and r["box"] == 2 and r["read 0"] == 3
    assert periodic.periodic_runs(docs.where("false")).count() == 0
    short = {r["doc_id"]: r["text"] for r in periodic.collapse(docs).collect()}
    assert short[1] == "the cat sat on the mat" and short[8] == "tick! tock" and short[3] is None and short[6] == LONG


def test_columns_named_like_results_give_way(docs):
    clashing = docs.selectExpr("doc_id", "text", "note", *[f"7 AS {c}" for c in RUNS])
    assert periodic.periodic_runs(clashing).where("doc_id = 1").first()["n_runs"] == 1
    read = docs.selectExpr("doc_id AS n_runs", "text AS start", "note")  # what is read may bear a result's name
    assert {r["n_runs"] for r in periodic.periodic_runs(read, key="n_runs", text="start").collect()} == {0, 1}


def test_very_frequent_words_and_long_repeats():
    words = np.zeros(400_000, dtype=np.int64)
    assert periodic.find_runs(words).tolist() == [[0, 400_000, 1]]
    rng = np.random.default_rng(2)
    block = rng.zipf(1.3, 50_000) % 500
    runs = periodic.find_runs(np.concatenate([block, block, block, block[:7], [501]]))
    assert [0, 150_007, 50_000] in runs.tolist() and (np.diff(runs[:, 0]) >= 0).all()


def test_runs_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r[c] for c in RUNS) for r in LLM["op11_periodic_runs"](spark, SMALL).collect()}
    assert len(found) == len(rows)
    for r in rows:
        words = queries.planted(r["doc_id"], (r["text"] or "").encode().split())
        if len(words) < 4000:
            assert found[r["doc_id"]] == brute_row(words)


def brute_search(docs, items, k=20):
    """Rows ``item, rank, doc_id, score``; ``docs`` are (id, text), equal ids are rows of their own."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = [(i, Counter(term.findall((t or "").translate(low)))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(term.findall((text or "").translate(low)))
    found = []
    for item, wants in asked.items():
        scores = []
        for i, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(length, 1)
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w, q in wants.items()
                if w in c
            )
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        found += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


def got_rows(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


def test_search_of_awkward_rows(spark, docs):
    items = [(1, "THE Cat, sat"), (2, "tick tick tock"), (3, None), (4, "!"), (None, "x id"), (5, "nowhere"), (1, "THE Cat, sat"), (1, "mat"), (6, "日本語 w5 w29999")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "map('a', 1) AS tags", "3 AS term", "4 AS rank")
    index = ranked.build_index(docs)
    assert got_rows(ranked.search(asked, index)) == brute_search([(r[0], r[1]) for r in ROWS], items)
    assert got_rows(ranked.search(asked, index, block_terms=4)) == brute_search([(r[0], r[1]) for r in ROWS], items)
    assert ranked.search(asked.where("false"), index).count() == 0
    empty = ranked.build_index(docs.where("false"))
    assert ranked.search(asked, empty).count() == 0
    assert ranked.search(asked, ranked.build_index(docs.where("text IS NULL"))).count() == 0


@pytest.mark.parametrize("k", [1, 5, 20])
def test_search_over_shards_with_copies_and_ties(spark, k):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 30))) for _ in range(800)]
    texts[100:350] = [texts[100]] * 250  # one text a third of the rows
    rows = [(i * 3 % 801, t) for i, t in enumerate(texts)]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for j in range(40)] + [(99, texts[100])]
    index = ranked.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_words=900)
    assert index.count() > 5
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got_rows(ranked.search(asked, index, k=k)) == brute_search(rows, items, k)


def test_search_skips_documents():
    """A best-first search scores few of the documents when an item has clear winners."""
    rng = random.Random(3)
    words = [[b"w%d" % int(rng.paretovariate(0.6)) for _ in range(40)] for _ in range(3000)]
    row = ranked.shard_row(list(range(3000)), words)
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), *map(pa.list_, [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 3])]
    batch = pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds)], names=ranked.INDEX.names)
    asked = Counter(w.decode() for w in words[17])
    held = Counter(w.decode() for some in words for w in set(some))
    found = ranked.Queries([{"item": 0, "term": t, "qtf": q} for t, q in asked.items()], held, 3000)
    postings, ids, given_, lists = ranked.shard_postings(batch, 0, pa.array(found.terms, pa.string()), 3000, 120_000)
    best = ranked.Best(1, 3)
    ((items, numbered, weights),) = found.groups()
    scored = ranked.search_group(postings, ids, given_, items, lists[numbered], weights, best)
    assert best.rows[0, 3] == 17 and scored < 1000


@functools.cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole_counts(text):
    return len(library().encode(text, add_special_tokens=False))


def word_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PARTS = ["a", "don't", "'S", " ", "\n", "é", "12", "...", "'ll", "’", "<|endoftext|>", "  ", "\t", "日本", "\xa0", "É_", "é", "́", "İ", "ΑΣ", "ß", "\x1c", "\x85", "ﬁ", "\r\n", "½", "WORDS", "'", "x" * 40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10))
def test_counts_are_the_librarys(parts):
    text = "".join(parts)
    known = token_counts.lengths(word_path())
    for table in ({}, {"a": 1, "'": 1}):
        tiers = token_counts.Tiers(table, known.pieces)
        assert known.count(text, tiers) == known.whole(text) and len(tiers) == len(table)


def test_counts_of_awkward_rows(docs):
    rows = token_counts.count_tokens(docs, word_path(), limit=100).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), whole_counts(text))
        assert r["over_limit"] == (r["n_tokens"] > 100) and r["tags"] == {"k": r["note"]}
    assert token_counts.count_tokens(docs.where("false"), word_path()).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "9 AS n_tokens", "9 AS n_bytes", "9 AS over_limit")
    assert token_counts.count_tokens(clashing, word_path()).where("n_tokens = 9").count() <= 1


def test_other_tokenizers_count_whole_texts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs.where("doc_id < 6"), path).collect():
        assert r["n_tokens"] == len(whole.encode(r["text"] or "", add_special_tokens=False))


def test_bounded_tables_and_caches(spark, docs, monkeypatch):
    monkeypatch.setattr(token_counts, "TASK_DISTINCT", 50)
    monkeypatch.setattr(token_counts, "TASK_ENTRIES", 20)
    assert len(token_counts.frequent_lengths(docs, word_path(), entries=10)) == 10
    kept = token_counts.Lengths(word_path())
    kept.pieces.size = 3
    text = " ".join(f"w{i % 11}" for i in range(200))
    tiers = token_counts.Tiers({}, kept.pieces)
    assert kept.count(text, tiers) == kept.whole(text) and len(kept.pieces) <= 3 and len(kept.pieces.old) <= 3


def test_counts_query_is_the_library(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in LLM["op13_token_counts"](spark, SMALL).collect()}
    for r in rows:
        n = whole_counts(r["text"] or "")
        assert found[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 2048)
    assert len(found) == len(rows)
