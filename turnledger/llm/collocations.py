"""Phrase collocations a language, counted with broadcast double-array tries.

Candidates come level by level. Words are counted by spelling. A pair can only be frequent if
both its words are and if its bucket total, over 64-bit hashes of pairs, reaches the least
count; a run of three only if both its pairs can be and its own bucket total does. These
bounds never lose a frequent phrase. The texts are then gone through once more: at every position
of a possible pair lies a window of two or three words, and equal windows become one row with their
number. The candidates go into double-array tries of bounded size; each trie is broadcast, numpy
moves the states of all its windows forward together, counts accepting states as often as the
windows occur, and the sums are the phrases' exact counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.double_array import Trie, build
from turnledger.llm.frames import pin, prepare, text_bytes
from turnledger.llm.text import byte_codes, mix, slices, words

LEAST = 10
TOP = 2000
#: Percent of a phrase's occurrences inside one longer candidate at which it is dropped.
COVERED = 50
LONGEST = 3
SCALE = 1_000_000

#: Candidates of one trie, and tries that are broadcast at once.
PHRASES_PER_TRIE = 1 << 18
TRIES_PER_PASS = 3
#: Groups of first words by which phrases are dealt to tries.
FIRST_WORD_BUCKETS = 1 << 12
#: Bits of the broadcast filters; other words, pairs and runs that share a bit stay candidates.
FILTER_BITS = 1 << 27
#: Bytes hashed at once, which a processor's cache should hold, and bytes counted at once.
SLICE, RUN = 512 << 10, 4 << 20
SEEDS = 8

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[list(b" \t")] = True
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Run:
    """Words of some documents in reading order: keys of language and word, and whether the next word joins."""

    keys: np.ndarray
    joined: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    languages: np.ndarray
    data: np.ndarray

    @staticmethod
    def joint(runs: list[Run]) -> Run:
        """One run after the other; the last word of each joins nothing."""
        base = np.cumsum([0] + [len(run.data) for run in runs])
        starts = [run.starts + at for run, at in zip(runs, base, strict=False)]
        ends = [run.ends + at for run, at in zip(runs, base, strict=False)]
        rest = zip(*((run.keys, run.joined, run.languages, run.data) for run in runs), strict=True)
        keys, joined, languages, data = map(np.concatenate, rest)
        return Run(keys, joined, np.concatenate(starts), np.concatenate(ends), languages, data)


class Reader:
    """Word keys of texts; ``seed`` chooses the hash."""

    def __init__(self, seed: int):
        self.codes = mix(byte_codes(fold_case=True) + np.uint64(seed))
        self.seed = seed

    def language_key(self, language: str) -> int:
        own = hashlib.blake2b(language.encode(), digest_size=8, salt=self.seed.to_bytes(8, "little"))
        return int.from_bytes(own.digest(), "little")

    def runs(self, batch: pa.RecordBatch) -> Iterator[Run]:
        languages = batch["lang"].dictionary_encode()
        of_language = np.array([self.language_key(x) for x in languages.dictionary.to_pylist()], dtype=np.uint64)
        index = languages.indices.to_numpy(zero_copy_only=False)
        held: list[Run] = []
        for part in slices(batch["body"], SLICE):
            found = words(part, _SEPARATOR, self.codes)
            document = np.repeat(np.arange(part.first, part.last), found.counts)
            breaks = np.zeros(len(part.data) + 1, dtype=np.int64)
            np.cumsum(_BREAK[part.data], out=breaks[1:])
            piece = breaks[found.starts] + document
            joined = np.zeros(len(document), dtype=bool)
            joined[:-1] = piece[1:] == piece[:-1]
            keys = mix(found.hashes ^ of_language[index[document]]) if len(document) else found.hashes
            held.append(Run(keys, joined, found.starts, found.ends, index[document], part.data))
            if sum(len(run.data) for run in held) >= RUN:
                yield Run.joint(held)
                held = []
        if held:
            yield Run.joint(held)

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """A bucket for each two neighbours."""
        return mix(keys[:-1] * _MULTIPLIER + keys[1:])

    def threes(self, pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A bucket for each three neighbours."""
        return mix(pairs[:-1] * _MULTIPLIER + keys[2:])


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def filter_of(keys: DataFrame) -> np.ndarray:
    """The low bits of all ``key`` values as one bitmap of ``FILTER_BITS``."""
    low = F.col("key").bitwiseAND(FILTER_BITS - 1) + 1
    parts = (
        keys.groupBy(F.bitmap_bucket_number(low).alias("at"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for at, own in zip(parts["at"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        bits[(at - 1) * 4096 : at * 4096] = np.frombuffer(own, dtype=np.uint8)
    return bits


def counted(keys: np.ndarray) -> pa.RecordBatch:
    key, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def word_counts(texts: DataFrame, reader: Reader) -> DataFrame:
    """``key, lang, word, n`` of all words; ``clash`` marks a key that two of them share."""

    def count(batches):
        for batch in batches:
            names = batch["lang"].dictionary_encode().dictionary
            for run in reader.runs(batch):
                which, key = pd.factorize(run.keys)
                n, first = np.bincount(which, minlength=len(key)), np.zeros(len(key), dtype=np.int64)
                first[which[::-1]] = np.arange(len(which))[::-1]
                bodies = [run.data[a:b].tobytes().lower() for a, b in zip(run.starts[first], run.ends[first], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        names.take(pa.array(run.languages[first])).cast(pa.string()),
                        pa.array(bodies, pa.binary()).cast(pa.string()),
                        pa.array(n),
                    ],
                    names=["key", "lang", "word", "n"],
                )

    spelled = F.struct("lang", "word")
    return (
        texts.mapInArrow(count, "key long, lang string, word string, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.min(spelled).alias("least"), F.max(spelled).alias("most"))
        .select("key", "least.lang", "least.word", "n", (F.col("least") != F.col("most")).alias("clash"))
    )


def windows(texts: DataFrame, reader: Reader, frequent: DataFrame, least: int) -> DataFrame:
    """Text positions of phrases that can occur ``least`` times: ``w1, w2, w3, n``.

    A window has the pair at a position and the word that makes it a run of three, if that can
    occur as often; ``n`` positions have the same.
    """
    context = texts.sparkSession.sparkContext
    words_kept = context.broadcast(filter_of(frequent))

    def possible_pairs(run: Run) -> tuple[np.ndarray, np.ndarray]:
        good = held(words_kept.value, run.keys)
        return reader.pairs(run.keys), run.joined[:-1] & good[:-1] & good[1:]

    def totals(rows) -> DataFrame:
        found = texts.mapInArrow(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return found.where(F.col("n") >= least).select("key")

    def pair_buckets(batches):
        for batch in batches:
            for run in reader.runs(batch):
                pair, good = possible_pairs(run)
                yield counted(pair[good])

    pairs_kept = context.broadcast(filter_of(totals(pair_buckets)))

    def good_pairs(run: Run) -> tuple[np.ndarray, np.ndarray]:
        pair, good = possible_pairs(run)
        good[good] = held(pairs_kept.value, pair[good])
        return pair, good

    def three_buckets(batches):
        for batch in batches:
            for run in reader.runs(batch):
                pair, good = good_pairs(run)
                yield counted(reader.threes(pair, run.keys)[good[:-1] & good[1:]])

    threes_kept = context.broadcast(filter_of(totals(three_buckets)))

    def found(batches):
        for batch in batches:
            for run in reader.runs(batch):
                pair, good = good_pairs(run)
                three = reader.threes(pair, run.keys)
                long = good[:-1] & good[1:]
                long[long] = held(threes_kept.value, three[long])
                for at, bucket, length in (
                    (np.flatnonzero(good & ~np.append(long, False)), pair, 2),
                    (np.flatnonzero(long), three, 3),
                ):
                    rows = np.stack([bucket[at], *(run.keys[at + k] for k in range(length))])
                    rows = rows[:, np.lexsort(rows)]
                    fresh = np.ones(rows.shape[1], dtype=bool)
                    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
                    out = [pa.array(r[fresh].view(np.int64)) for r in rows[1:]]
                    out += [pa.nulls(int(fresh.sum()), pa.int64())] * (LONGEST - length)
                    n = np.diff(np.append(np.flatnonzero(fresh), len(fresh)))
                    yield pa.RecordBatch.from_arrays([*out, pa.array(n)], names=["w1", "w2", "w3", "n"])

    rows = texts.mapInArrow(found, "w1 long, w2 long, w3 long, n long")
    return rows.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"))


def candidates(found: DataFrame, least: int) -> DataFrame:
    """Phrases of the windows that can occur ``least`` times: ``w1, w2, w3``."""
    pairs = found.groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    pairs = pairs.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "n")
    threes = found.where(F.col("w3").isNotNull())
    return pairs.unionByName(threes).where(F.col("n") >= least).drop("n")


def phrase_counts(found: DataFrame, least: int) -> DataFrame:
    """``w1, w2, w3, a``: exact occurrences of each candidate, from tries of bounded size."""
    spark = found.sparkSession
    found = pin(found, "phrase-windows")
    dealt, n_tries = dealt_to_tries(pin(candidates(found, least), "phrase-candidates"))
    # Numbers inside a trie: about as many phrases are dealt to each.
    number = F.row_number().over(Window.partitionBy("trie").orderBy("w1", "w2", "w3")) - 1
    dealt = pin(dealt.withColumn("phrase", number), "phrase-tries")
    sums = spark.createDataFrame([], "trie int, phrase long, a long")
    for first in range(0, n_tries, TRIES_PER_PASS):
        numbers = range(first, min(first + TRIES_PER_PASS, n_tries))
        tries = [_trie(dealt, n) for n in numbers]
        sent = spark.sparkContext.broadcast(tries)
        del tries
        # Windows whose first word is in none of these tries are left to the others.
        own = dealt.where(F.col("trie").isin(*numbers)).select(_bucket("w1").alias("bucket")).distinct()
        here = found.withColumn("bucket", _bucket("w1")).join(F.broadcast(own), "bucket", "left_semi")
        sums = sums.unionByName(pin(_walk(here.drop("bucket"), sent, first), "phrase-counts"))
        sent.destroy()
    return sums.join(dealt, ["trie", "phrase"]).select("w1", "w2", "w3", "a")


def _bucket(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FIRST_WORD_BUCKETS))


def dealt_to_tries(phrases: DataFrame) -> tuple[DataFrame, int]:
    """Phrases with the ``trie`` of each, and the number of tries.

    First words lie together, so that a window goes on in the one trie of its word and not in all.
    A group of first words has a stretch of numbers, as long as it has phrases, in which the hash
    places each: one with very many phrases lies over as many tries as it needs.
    """
    grouped = phrases.withColumn("bucket", _bucket("w1"))
    sizes = sorted(tuple(r) for r in grouped.groupBy("bucket").agg(F.count(F.lit(1))).collect())
    stretches, total = [], 0
    for bucket, size in sizes:
        stretches.append((bucket, total, size))
        total += size
    of_bucket = phrases.sparkSession.createDataFrame(stretches, "bucket long, first long, size long")
    place = F.col("first") + F.pmod(F.xxhash64("w1", "w2", "w3"), F.col("size"))
    dealt = grouped.join(F.broadcast(of_bucket), "bucket").select(
        "w1", "w2", "w3", F.floor(place / PHRASES_PER_TRIE).cast("int").alias("trie")
    )
    return dealt, -(-total // PHRASES_PER_TRIE)


def _trie(dealt: DataFrame, number: int) -> Trie:
    own = dealt.where(F.col("trie") == number).select("phrase", "w1", "w2", "w3").toArrow().sort_by("phrase")
    keys = [own[c].fill_null(0).to_numpy().astype(np.int64).view(np.uint64) for c in ("w1", "w2", "w3")]
    return build(np.stack(keys, axis=1), LONGEST - own["w3"].is_null().to_numpy().astype(np.int64))


def _walk(found: DataFrame, sent: Broadcast, first: int) -> DataFrame:
    """Sums of the accepting states of the broadcast tries, numbered from ``first``, over all windows."""

    def walk(batches):
        sums = [np.zeros(t.n_phrases, dtype=np.int64) for t in sent.value]
        for batch in batches:
            # Windows one after the other, the last word of each joins nothing.
            long = ~batch["w3"].is_null().to_numpy(zero_copy_only=False)
            joined = np.stack([np.ones(len(long), dtype=bool), long, np.zeros(len(long), dtype=bool)], axis=1).ravel()
            keys = np.stack([batch[c].fill_null(0).to_numpy() for c in ("w1", "w2", "w3")], axis=1).ravel()
            which, distinct = pd.factorize(keys.view(np.uint64))
            starts, times = np.arange(len(long)) * LONGEST, batch["n"].to_numpy()
            for own, trie in zip(sums, sent.value, strict=True):
                own += trie.count(trie.codes(distinct), joined, LONGEST, which, starts, times)
        for number, own in enumerate(sums, first):
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), number, dtype=np.int32)), pa.array(seen), pa.array(own[seen])],
                names=["trie", "phrase", "n"],
            )

    sums = found.mapInArrow(walk, "trie int, phrase long, n long")
    return sums.groupBy("trie", "phrase").agg(F.sum("n").alias("a"))


def _score(a: str, left: str, right: str) -> Column:
    """``floor(SCALE * a * a / (left * right))`` in exact decimals; a run may occur 10^15 times."""
    squared = " * ".join([f"CAST({a} AS DECIMAL(15,0))"] * 2)
    return F.expr(
        f"({squared} * {SCALE}) DIV (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))"
    )


def scored(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: ``lang, phrase, a, l, r, score``, covered pairs left out."""

    def word(number: int) -> DataFrame:
        return vocabulary.select(
            F.col("key").alias(f"w{number}"), F.col("lang").alias(f"lang{number}"),
            F.col("word").alias(f"word{number}"), F.col("n").alias(f"n{number}"),
        )

    pairs = counts.where(F.col("w3").isNull()).select("w1", "w2", "a")
    threes = counts.where(F.col("w3").isNotNull())
    inside = (
        threes.select("w1", "w2", "a")
        .unionByName(threes.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("w1", "w2")
        .agg(F.max("a").alias("covered"))
    )
    of_two = (
        pairs.join(inside, ["w1", "w2"], "left")
        .where(F.col("covered").isNull() | (100 * F.col("covered") < COVERED * F.col("a")))
        .join(word(1), "w1")
        .join(word(2), "w2")
        .select(
            F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), "a",
            F.col("n1").alias("l"), F.col("n2").alias("r"),
        )
        .withColumn("score", _score("a", "l", "r"))
    )
    left = pairs.withColumnRenamed("a", "a12")
    right = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"))
    second = F.col("second") < F.col("first")
    of_three = (
        threes.join(left, ["w1", "w2"])
        .join(right, ["w2", "w3"])
        .join(word(1), "w1")
        .join(word(2), "w2")
        .join(word(3), "w3")
        .withColumn("first", _score("a", "n1", "a23"))
        .withColumn("second", _score("a", "a12", "n3"))
        .select(
            F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
            F.when(second, F.col("a12")).otherwise(F.col("n1")).alias("l"),
            F.when(second, F.col("n3")).otherwise(F.col("a23")).alias("r"),
            F.least("first", "second").alias("score"),
        )
    )
    return of_two.unionByName(of_three)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best collocations of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are runs outside blanks, tabs and the marks that end a piece; phrases stay inside a
    piece. A null language counts as ``und``, a null text as empty; neither empty nor blank
    texts have words. Repeated rows count each time. Equal scores rank by occurrences, then by
    the phrase in byte order. Texts are read whole, a few times their size in memory. An empty
    table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_bytes().alias("body"))
    for seed in range(SEEDS):
        reader = Reader(seed)
        vocabulary = pin(word_counts(texts, reader), "collocation-words")
        if vocabulary.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells all words apart")
    frequent = vocabulary.where(F.col("n") >= least)
    counts = phrase_counts(windows(texts, reader, frequent, least), least)
    counts = pin(counts.where(F.col("a") >= least), "collocation-counts")
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        scored(counts, frequent)
        .withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top)
        .join(sizes, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def op11_collocations(spark, sf_dir):
    return mine(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS p
  FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
parts AS (
  SELECT lang, p, k, a, cut, p[1:cut] AS lp, p[cut + 1:] AS rp FROM cand, (VALUES (1), (2)) AS t(cut) WHERE cut < k),
cuts AS (
  SELECT c.lang, c.p, c.a, c.cut, l.a AS l, r.a AS r,
         ({SCALE}::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM parts c
  JOIN f l ON l.lang = c.lang AND l.p = c.lp
  JOIN f r ON r.lang = c.lang AND r.p = c.rp),
low AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS place FROM cuts),
inner_pairs AS (
  SELECT lang, p[1:2] AS p, a FROM cand WHERE k = 3
  UNION ALL SELECT lang, p[2:3], a FROM cand WHERE k = 3),
covers AS (SELECT lang, p, max(a) AS covered FROM inner_pairs GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN covers USING (lang, p)
  WHERE place = 1 AND (covered IS NULL OR 100 * covered < {COVERED} * low.a)),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}
"""
