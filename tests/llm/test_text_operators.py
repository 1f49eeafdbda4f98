"""Collocations, lexical search and toxicity: brute force, awkward tables, parts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ROWS, SCHEMA
from pyspark.sql import functions as F

from turnledger.llm import collocations, lexical_search, toxicity
from turnledger.llm.double_array import build
from turnledger.llm.edit_trie import EditTrie, edits_allowed
from turnledger.llm.text import slices

FOLD = {i: i + 32 for i in range(65, 91)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- collocations ------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            own = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(own)
            for k in (1, 2, 3):
                for i in range(len(own) - k + 1):
                    counts[lang][tuple(own[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = [(p, a) for p, a in kept.items() if len(p) == 3]
        found = []
        for p, a in kept.items():
            if len(p) == 2 and any(p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out, key=repr)


REPEATS = [
    (1, "New York City. new york city, NEW YORK\tstate; York city" * 3, None, "a", 1),
    (2, "a a a a\x0ba a\x0ca a:b b b!b", "und", "a", 1),
    (3, "é ñ é ñ é\x0dñ", "fr", None, 1),
]


@pytest.mark.parametrize("least,top", [(2, 5), (3, 2000)])
def test_collocations_by_brute_force(spark, least, top):
    data = [*ROWS, *REPEATS, *REPEATS]
    got = collocations.mine(spark.createDataFrame(data, SCHEMA).repartition(3), least, top)
    assert rows_of(got) == brute_collocations(data, least, top)


def test_collocations_in_many_small_tries(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PHRASES_PER_TRIE", 7)
    monkeypatch.setattr(collocations, "TRIES_PER_PASS", 2)
    data = [*REPEATS, (4, "one two three one two three one two", "en", "a", 1)]
    got = collocations.mine(spark.createDataFrame(data, SCHEMA), 2, 2000)
    assert rows_of(got) == brute_collocations(data, 2, 2000)


def test_collocations_on_crowded_and_empty_tables(spark, awkward, crowded, nothing):
    assert rows_of(collocations.mine(crowded, 2)) == rows_of(collocations.mine(awkward, 2))
    assert collocations.mine(nothing).count() == 0


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**14, 3 * 10**14, 2 * 10**14)], "a long, l long, r long")
    assert row.select(collocations._score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 // 6


def test_double_array_counts():
    draw = random.Random(3)
    keys = [draw.randrange(1, 60) * 7919 for _ in range(20_000)]
    joined = [draw.random() < 0.8 for _ in keys]
    joined[-1] = False
    seen = Counter()
    for i in range(len(keys) - 1):
        if joined[i]:
            seen[keys[i], keys[i + 1]] += 1
            if joined[i + 1]:
                seen[keys[i], keys[i + 1], keys[i + 2]] += 1
    phrases = [*seen, (1, 2, 3), (7919, 5)]
    rows = np.array([p + (0,) * (3 - len(p)) for p in phrases], dtype=np.uint64)
    trie = build(rows, np.array([len(p) for p in phrases]))
    codes = trie.codes(np.array(keys, dtype=np.uint64))
    assert trie.count(codes, np.array(joined)).tolist() == [seen[p] for p in phrases]


# --- lexical search ----------------------------------------------------------------------

ITEMS = [
    (1, "The quick brown fox", "x"), (1, "The quick brown fox", "y"), (2, None, "x"), (3, "", None),
    (None, "la rue est belle", "x"), (4, "under the mit license mit", "x"), (5, "zzz unknown", "x"), (6, "w1 w2 w3 é", "x"),
]


def brute_search(rows, items, k=10):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(FOLD))

    docs = [(i, terms(t)) for i, t, *_ in rows]
    docs = [(i, ts) for i, ts in docs if ts]
    n_docs, n_terms = len(docs), sum(len(ts) for _, ts in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    out = []
    for item, text, _ in items:
        scores = []
        for i, ts in docs:
            tf, m = Counter(ts), 10 + 90 * len(ts) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in set(terms(text))
                if tf[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("documents,k", [(8192, 10), (2, 2), (1, 3)])
def test_search_by_brute_force(spark, monkeypatch, awkward, documents, k):
    monkeypatch.setattr(lexical_search, "DOCUMENTS", documents)
    items = spark.createDataFrame(ITEMS, "item_id long, text string, rank string")
    assert rows_of(lexical_search.search(awkward, items, k)) == brute_search(ROWS, ITEMS, k)


def test_search_on_crowded_and_empty_tables(spark, awkward, crowded, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string, doc_id string")
    assert rows_of(lexical_search.search(crowded, items)) == rows_of(lexical_search.search(awkward, items))
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(awkward, items.where("false")).count() == 0


def test_limited_accumulators_lose_nothing():
    draw = np.random.default_rng(5)
    n_docs, n_terms = 300, 12
    dense = draw.integers(0, 900, (n_docs, n_terms)) * (draw.random((n_docs, n_terms)) < np.linspace(0.02, 0.9, n_terms))
    document, term = np.nonzero(dense)
    block = lexical_search.Block.of(document, term, dense[document, term], n_docs, n_terms)
    for k in (1, 7, 400):
        for least in (0, 2500):
            found, scores = block.scores(np.arange(n_terms), k, least)
            totals = dense.sum(axis=1)
            want = sorted((-t for t in totals if t >= max(least, 1)))[:k]
            assert sorted(-scores)[:k] == want and (totals[found] == scores).all()


def test_length_factor_beyond_64_bits():
    n = np.array([10**6, 1])
    assert lexical_search.length_factor(n, 10**12, 10**15).tolist() == [10 + 90 * 10**18 // 10**15, 10]


# --- toxicity ----------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_edit_trie_by_brute_force():
    draw = random.Random(1)
    terms = ["idiot", "scum", "abc", "worthless", "disgusting", "vequée"]
    terms += ["".join(draw.choice("aébc") for _ in range(draw.randint(3, 10))) for _ in range(30)]
    words = [*terms, "", "x" * 400, "\U0001f600"]
    for _ in range(600):
        own = list(draw.choice(terms))
        for _ in range(draw.randint(1, 3)):
            at = draw.randrange(len(own) + 1)
            own[at : at + draw.randint(0, 1)] = draw.choice(["", "é", "z"])
        words.append("".join(own))
    found, far = EditTrie(terms).match(words)
    for word, term, edits in zip(words, found, far, strict=True):
        near = [(distance(word, t), i) for i, t in enumerate(terms) if word and distance(word, t) <= edits_allowed(len(t))]
        assert (term < 0) == (not near)
        if near:
            assert (edits, terms[term]) == (min(near)[0], terms[min(near)[1]])


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("what an idiot it is", [toxicity.PLAIN]),
        ('they put "idiot" on the wall', [toxicity.QUOTED]),
        ("they put «idiot» on it", [toxicity.QUOTED]),
        ("he said idiot again", [toxicity.QUOTED]),
        ("you are an idiot", [toxicity.ADDRESSED]),
        ('the end" of one. and here then stands the idiot alone', [toxicity.PLAIN]),
        ("idiot you one two three four five six idiot", [toxicity.ADDRESSED, toxicity.PLAIN]),
    ],
)
def test_contexts(text, kinds):
    finder = toxicity.Finder(EditTrie(["idiot"]))
    # A quote mark of the document before must not reach into this one.
    (part,) = slices(pa.array([b'ends with "', text.encode(), b'" begins with'], pa.binary()))
    document, kind, n = finder.places(part)
    assert n == 3 and document.tolist() == [1] * len(kinds)
    assert (kind % 3).tolist() == kinds


def taught(spark, n=400):
    draw = random.Random(7)
    own = ["".join(draw.choice(["ka", "lo", "mi", "tur", "ven"]) for _ in range(3)) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(own) for _ in range(40)]
        if toxic := i % 5 == 0:
            words[draw.randrange(40)] = draw.choice(["blorghead", "snivelwit"])
        docs.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    plain = " ".join(draw.choice(own) for _ in range(20))
    docs += [
        (1000, plain + " blorghead", "en", "a", 1), (1001, plain + " blorgheed", "en", "a", 1),
        (1002, plain, "en", "a", 1), (1003, None, None, None, None), (1004, "", "en", "a", 1),
        (None, plain + " snivelwit", "en", "a", 1), (1005, plain + " BLORGHEAD", None, "a", 1),
    ]
    return docs, labels


def test_toxicity_learns_terms_and_catches_misspellings(spark):
    docs, labels = taught(spark)
    docs = spark.createDataFrame(docs, SCHEMA).repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert sorted(model.lexicon) == ["blorghead", "snivelwit"]
    out = toxicity.score_toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "n_terms", "term"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 407 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, None, 1005)] == [1, 1, 0, 0, 0, 1, 1]
    assert got[1000]["score"] > got[1001]["score"] > got[1002]["score"] == got[1003]["score"]
    assert got[1001]["term"] == "blorghead" and got[1002]["term"] is None
    held = [r for i, r in got.items() if r["held_out"] and i is not None and i < 400]
    assert held and all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = taught(spark)
    docs = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.score_toxicity(docs, labels)) == rows_of(toxicity.score_toxicity(docs, turned))


def test_copied_words_are_no_terms(spark):
    # A toxic text copied many times would otherwise lend all its words to the lexicon.
    docs, labels = taught(spark)
    docs += [(2000 + i, f"harmless passage between fixed neighbours snivelwit {i}", "en", "a", 1) for i in range(200)]
    labels += [(2000 + i, 1, 1) for i in range(200)]
    docs = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert "passage" not in toxicity.learn(docs, labels).lexicon


def test_toxicity_on_awkward_tables(spark, awkward, crowded, nothing):
    odd = [(1, 1), (1, 0), (6, 0), (11, None), (None, 1), (77, 1)]
    labels = spark.createDataFrame([(i, t, "x") for i, t in odd], "doc_id long, toxic int, body string")
    plain = rows_of(toxicity.score_toxicity(awkward, labels))
    assert len(plain) == len(ROWS)
    assert plain == rows_of(toxicity.score_toxicity(crowded, labels))
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert toxicity.score_toxicity(awkward, labels.where("false")).count() == len(ROWS)


