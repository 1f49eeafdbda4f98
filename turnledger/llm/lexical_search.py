"""Ranked lexical search with a limit on accumulators, term at a time.

A first pass over the texts takes the corpus totals and, for the terms of the queries, the
documents that hold them. In the second, every task turns its documents into postings of the
query terms, some thousands of documents at a time. For each query the terms are taken rarest
first; a document gets an accumulator at the first of its terms. Once the greatest sum that
the remaining terms can give is below the kth partial score, no new accumulator can reach the
result, so only the existing ones are updated, each to its exact score. A task carries its
kth score from one block of documents to the next and returns k documents a query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.frames import pin, prepare, scratch_path, text_bytes
from turnledger.llm.text import byte_codes, slices, words

K = 10
#: Queries whose terms are broadcast together.
ITEMS_PER_BLOCK = 1024
#: Documents and postings scored together.
DOCUMENTS, POSTINGS = 8192, 1 << 21
SLICE = 4 << 20

SCHEMA = "item_id long, rank int, doc_id long, score long"

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[128:] = False
_SEPARATOR[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_CODES = byte_codes(fold_case=True)


def weight(n_documents: int, df: int) -> int:
    """A term's weight; it is never below 0."""
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """``10 + (90 * n * n_documents) div n_terms`` for documents of ``n`` terms."""
    if 90 * int(n.max(initial=0)) * n_documents >= 2**63:
        return np.array([10 + 90 * int(x) * n_documents // n_terms for x in n], dtype=np.int64)
    return 10 + 90 * n.astype(np.int64) * n_documents // max(n_terms, 1)


def query_terms(items: DataFrame) -> DataFrame:
    """``item_row, item_id, terms``: the distinct term keys of each row."""

    def terms(batches):
        for batch in batches:
            out = [
                np.unique(found.hashes[a:b]).view(np.int64)
                for part in slices(batch["body"], SLICE)
                for found in [words(part, _SEPARATOR, _CODES)]
                for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["item_row"], batch["item_id"], pa.array(out, pa.list_(pa.int64()))],
                names=["item_row", "item_id", "terms"],
            )

    rows = items.select(
        F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"),
        text_bytes().alias("body"),
    )
    return rows.mapInArrow(terms, "item_row long, item_id long, terms array<long>")


class Vocabulary:
    """The sorted term keys of a block of queries."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def postings(self, part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and occurrences of each posting, and the terms of each document."""
        found = words(part, _SEPARATOR, _CODES)
        counts = found.counts
        if not len(self.keys):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, counts
        at = np.minimum(np.searchsorted(self.keys, found.hashes), len(self.keys) - 1)
        hit = self.keys[at] == found.hashes
        document = np.repeat(np.arange(len(counts)), counts)[hit]
        pair, tf = np.unique(document * len(self.keys) + at[hit], return_counts=True)
        return pair // len(self.keys), pair % len(self.keys), tf, counts


@dataclass
class Block:
    """Postings of some documents by term: document, contribution; and each term's greatest contribution."""

    n_documents: int
    documents: np.ndarray
    contributions: np.ndarray
    bounds: np.ndarray
    greatest: np.ndarray

    @staticmethod
    def of(document, term, contribution, n_documents: int, n_terms: int) -> Block:
        order = np.argsort(term, kind="stable")
        bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        greatest = np.zeros(n_terms, dtype=np.int64)
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(full):
            greatest[full] = np.maximum.reduceat(contribution[order], bounds[full])
        return Block(n_documents, document[order], contribution[order], bounds, greatest)

    def scores(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of all documents that can be among the k best and reach ``least``.

        ``terms`` come rarest first. Returns the documents and their scores.
        """
        rest = np.append(np.cumsum(self.greatest[terms][::-1])[::-1], 0)
        sums = np.zeros(self.n_documents, dtype=np.int64)
        made = np.zeros(self.n_documents, dtype=bool)
        kth, open_ = least, True
        for j, term in enumerate(terms):
            a, b = self.bounds[term], self.bounds[term + 1]
            if a == b:
                continue
            open_ = open_ and rest[j] >= kth
            own, gained = self.documents[a:b], self.contributions[a:b]
            if not open_:
                old = made[own]
                own, gained = own[old], gained[old]
            sums[own] += gained
            if open_:
                made[own] = True
                if rest[j + 1] < sums.max() and self.n_documents >= k:
                    kth = max(kth, int(np.partition(sums, self.n_documents - k)[self.n_documents - k]))
        found = np.flatnonzero(made & (sums >= max(least, 1)))
        if len(found) > k:
            kth = np.partition(sums[found], len(found) - k)[len(found) - k]
            found = found[sums[found] >= kth]
        return found, sums[found]


def _merge(best: list, documents, ids, scores, k: int) -> list:
    """The k best of ``best`` and the new documents: highest score, then smallest id, null last."""
    fresh = [(-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(documents, scores, strict=True)]
    return sorted(best + fresh)[:k]


def _search_block(texts: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    spark = texts.sparkSession
    own = [np.asarray(t, dtype=np.int64).view(np.uint64) for t in queries["terms"].to_pylist()]
    keys = np.unique(np.concatenate([*own, np.zeros(0, dtype=np.uint64)]))
    context = spark.sparkContext
    vocabulary = context.broadcast(Vocabulary(keys))

    def totals(batches):
        df, n_documents, n_terms = np.zeros(len(keys), dtype=np.int64), 0, 0
        for batch in batches:
            for part in slices(batch["body"], SLICE):
                _, term, _, counts = vocabulary.value.postings(part)
                df += np.bincount(term, minlength=len(df))
                n_documents, n_terms = n_documents + int((counts > 0).sum()), n_terms + int(counts.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [n_documents, n_terms]))],
            names=["term", "n"],
        )

    sums = texts.mapInArrow(totals, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
    n_documents, n_terms = counts.get(-1, 0), counts.get(-2, 0)
    df = np.array([counts.get(t, 0) for t in range(len(keys))], dtype=np.int64)
    weights = np.array([weight(n_documents, int(x)) for x in df], dtype=np.int64)
    # Rarest first; terms that no document holds add nothing.
    ranked = []
    for terms in own:
        at = np.searchsorted(keys, terms)
        at = at[df[at] > 0]
        ranked.append(at[np.lexsort((at, df[at]))])
    sent = context.broadcast((weights, ranked))

    def rank(batches):
        weights, ranked = sent.value
        best: list[list] = [[] for _ in ranked]
        parts, ids, n_postings = [], [], 0

        def flush():
            nonlocal parts, ids, n_postings
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                block = Block.of(*columns, len(ids), len(weights))
                for number, terms in enumerate(ranked):
                    least = -best[number][-1][0] if len(best[number]) == k else 0
                    found, scores = block.scores(terms, k, least)
                    if len(found):
                        best[number] = _merge(best[number], found, ids, scores, k)
            parts, ids, n_postings = [], [], 0

        for batch in batches:
            names = batch["doc_id"].to_pylist()
            for part in slices(batch["body"], SLICE):
                document, term, tf, n = vocabulary.value.postings(part)
                m = length_factor(n, n_documents, n_terms)[document]
                gained = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                parts.append((document + len(ids), term, gained))
                ids += names[part.first : part.last]
                n_postings += len(term)
                if len(ids) >= DOCUMENTS or n_postings >= POSTINGS:
                    flush()
        flush()
        rows = [(number, None if null else doc, -score) for number, own in enumerate(best) for score, null, doc in own]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"]
        )

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(pa.table({"item": np.arange(len(own)), "item_id": queries["item_id"]}))
    return (
        texts.mapInArrow(rank, "item long, doc_id long, score long")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .join(F.broadcast(names), "item")
        .select("item_id", "rank", "doc_id", "score")
    )


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents with a score above 0 for every item: ``item_id, rank, doc_id, score``.

    Every row of ``items`` is a query, repeated ones too; its terms count once each. Null and
    empty texts have no terms: such documents are never found, such items find nothing. Equal
    scores rank by ``doc_id``, null last; repeated rows of a document take a rank each. Texts
    are read whole, a few times their size in memory. Empty tables give no rows; other columns
    are ignored.
    """
    spark = prepare(docs.sparkSession)
    queries = pin(query_terms(items), "search-items")
    n_items = queries.count()
    if not n_items:
        return spark.createDataFrame([], SCHEMA)
    n_blocks = -(-n_items // ITEMS_PER_BLOCK)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    path = scratch_path(spark, "lexical-results")
    for number in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("item_row"), F.lit(n_blocks)) == number).toArrow()
        if block.num_rows:
            _search_block(texts, block, k).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def op12_lexical_search(spark, sf_dir):
    read = prepare(spark).read
    return search(read.parquet(f"{sf_dir}/documents.parquet"), read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
corpus AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs WHERE len(ts) > 0),
postings AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM docs) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, corpus GROUP BY t),
scores AS (
  SELECT item_id, doc_id,
         sum(w * (1000000000 * tf // (1000 * tf + 8 * (100 - 90 + 90 * n * n_docs // n_terms))))::BIGINT AS score
  FROM items JOIN postings USING (t) JOIN weights USING (t), corpus
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
