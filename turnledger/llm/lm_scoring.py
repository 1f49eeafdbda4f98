"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Words are counted over all training texts. The most frequent ones are the model's
vocabulary; the rest share classes by their ending, inside which a word has its smoothed
share of the counts. A context of two classes predicts the next one: the context vector is
the sum of two class vectors, scaled per position, and the score of a class is its product
with the class's output vector plus a bias. Every partition trains on all its tokens with
numpy, and parameters are averaged by tokens after each round.

Counts of frequent words are broadcast, at most ``HEAD_WORDS`` of them; the others meet
their counts in a join, so the vocabulary may grow without bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.llm.frames import crc_of_id, pin, prepare, text_bytes
from turnledger.llm.text import WHITESPACE, Slice, as_long, byte_codes, per_document, slices, words

FOLDS, HELD_OUT_FOLD = 7, 2
HEAD_WORDS = 1 << 18
CLASSES = 512
WIDTH = 16
#: Classes of words outside the vocabulary come first, then the start of a text.
OTHERS = 64
START = OTHERS
END_HASH = np.uint64(0x5851F42D4C957F2D)
NOISE = 64
BATCH = 1024
RATE = 0.1
ROUNDS = 2
TRAIN_TOKENS = 1 << 20
CONTEXTS_AT_ONCE = 4096
SEED = 6

_CODES = byte_codes(fold_case=True)
_OTHER_BITS = np.uint64(OTHERS - 1)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def held_out() -> Column:
    return crc_of_id() % FOLDS == HELD_OUT_FOLD


def tokens(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents with an end after each, and the bounds.

    The low bits of a hash are the class of the word's last two bytes.
    """
    found = words(part, WHITESPACE, _CODES)
    last = _LOWER[part.data[found.ends - 1]]
    ending = last * np.uint64(257) + _LOWER[part.data[np.maximum(found.ends - 2, found.starts)]]
    ending = (ending * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    hashes = (found.hashes & ~_OTHER_BITS) | (ending & _OTHER_BITS)
    bounds = found.bounds + np.arange(len(found.bounds))
    out = np.full(bounds[-1], END_HASH, dtype=np.uint64)
    inner = np.ones(bounds[-1], dtype=bool)
    inner[bounds[1:] - 1] = False
    out[inner] = hashes
    return out, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each token occurs in ``docs``, summed per task before the shuffle."""

    def count(batches):
        for batch in batches:
            found = [tokens(part)[0] for part in slices(batch.column("body"))]
            if found:
                word, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(word)), pa.array(n)], names=["word", "n"])

    counted = docs.select(text_bytes().alias("body")).mapInArrow(count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """Frequent words, sorted by hash, with counts and model classes, and the totals of all:
    ``other_counts`` and ``other_words`` by class of ending, the vocabulary left out."""

    word: np.ndarray
    count: np.ndarray
    klass: np.ndarray
    least: int
    total: int
    distinct: int
    other_counts: np.ndarray
    other_words: np.ndarray

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token among the frequent words, and whether it is there."""
        at = np.searchsorted(self.word, found)
        at[at == len(self.word)] = 0
        there = self.word[at] == found if len(self.word) else np.zeros(len(found), dtype=bool)
        return at, there

    def classes(self, found: np.ndarray) -> np.ndarray:
        ending = (found & _OTHER_BITS).astype(np.int64)
        at, there = self.find(found)
        return np.where(there, self.klass[at], ending) if len(self.word) else ending

    def class_counts(self) -> np.ndarray:
        own = np.bincount(self.klass, weights=self.count, minlength=CLASSES)
        own[:OTHERS] = self.other_counts
        own[START] = 0
        return own

    def other_norms(self) -> np.ndarray:
        """Counts and distinct words of each shared class, plus one for an unseen word."""
        return self.other_counts + self.other_words + 1.0


def frequent_words(counts: DataFrame) -> Head:
    """The words from a count upwards of which there are at most ``HEAD_WORDS``.

    The threshold comes from a histogram over steps of an eighth of a power of two.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))
    rows = sorted(histogram.collect(), key=lambda r: -r["step"])
    held, least = 0, None
    for row in rows:
        if held + row["words"] > HEAD_WORDS:
            break
        held, least = held + row["words"], row["step"]
    total, distinct = sum(r["tokens"] for r in rows), sum(r["words"] for r in rows)
    other_counts, other_words = np.zeros(OTHERS), np.zeros(OTHERS)
    ending = F.col("word").bitwiseAND(F.lit(OTHERS - 1)).cast("int").alias("ending")
    for row in counts.groupBy(ending).agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect():
        other_counts[row["ending"]], other_words[row["ending"]] = row["tokens"], row["words"]
    if least is None:
        none = np.zeros(0, dtype=np.int64)
        return Head(none.astype(np.uint64), none, none, 2**62, total, distinct, other_counts, other_words)
    found = counts.where(step >= least).toArrow()
    word = found["word"].to_numpy().view(np.uint64)
    n = found["n"].to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    klass = (word & _OTHER_BITS).astype(np.int64)
    named = np.lexsort((word, -n))[: CLASSES - OTHERS - 1]
    other_counts -= np.bincount(klass[named], weights=n[named], minlength=OTHERS)
    other_words -= np.bincount(klass[named], minlength=OTHERS)
    klass[named] = START + 1 + np.arange(len(named))
    return Head(word, n, klass, int(n.min()), total, distinct, other_counts, other_words)


class LogBilinear:
    """Parameters of the model as one flat vector with views."""

    SIZE = 2 * CLASSES * WIDTH + 2 * WIDTH + CLASSES

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        cut = CLASSES * WIDTH
        self.seen = flat[:cut].reshape(CLASSES, WIDTH)
        self.next = flat[cut : 2 * cut].reshape(CLASSES, WIDTH)
        self.scale = flat[2 * cut : 2 * cut + 2 * WIDTH].reshape(2, WIDTH)
        self.bias = flat[2 * cut + 2 * WIDTH :]

    @classmethod
    def start(cls, class_counts: np.ndarray) -> LogBilinear:
        """Small random vectors, and biases that give the class frequencies."""
        model = cls(np.random.default_rng(SEED).normal(0, 0.1, cls.SIZE).astype(np.float32))
        model.scale[:] = 0.5
        model.bias[:] = np.log((class_counts + 0.5) / (class_counts.sum() + 0.5 * CLASSES))
        return model

    def context(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.seen[before] + self.scale[1] * self.seen[last]

    def log_norms(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all classes, by matrix products over contexts."""
        out = np.empty(len(before), dtype=np.float64)
        bias = self.bias.copy()
        bias[START] = -np.inf
        for at in range(0, len(before), CONTEXTS_AT_ONCE):
            own = slice(at, at + CONTEXTS_AT_ONCE)
            score = self.context(before[own], last[own]) @ self.next.T + bias
            top = score.max(axis=1)
            score -= top[:, None]
            out[own] = top + np.log(np.exp(score).sum(axis=1, dtype=np.float64))
        return out

    def train(
        self, triples: np.ndarray, weights: np.ndarray, noise_p: np.ndarray, rng: np.random.Generator, seen: np.ndarray
    ) -> None:
        """One pass of noise-contrastive steps over weighted triples (before, last, next).

        ``seen`` sums squared slopes; a parameter's steps shrink with it.
        """
        cumulative = np.cumsum(noise_p)
        log_noise = np.log(NOISE * np.maximum(noise_p, 1e-12)).astype(np.float32)
        order = rng.permutation(len(weights))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            before, last, word = triples[own].T
            weight = weights[own].astype(np.float32)[:, None]
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), CLASSES - 1)
            hidden = self.context(before, last)
            true_score = (hidden * self.next[word]).sum(axis=1) + self.bias[word] - log_noise[word]
            false_score = hidden @ self.next[drawn].T + self.bias[drawn] - log_noise[drawn]
            true_pull = weight * (1 - _sigmoid(true_score))[:, None]
            false_pull = -weight * _sigmoid(false_score)
            pull = true_pull * self.next[word] + false_pull @ self.next[drawn]
            slope = LogBilinear(np.zeros_like(self.flat))
            _add_rows(slope.next, word, true_pull * hidden)
            _add_rows(slope.next, drawn, false_pull.T @ hidden)
            _add_rows(slope.seen, before, pull * self.scale[0])
            _add_rows(slope.seen, last, pull * self.scale[1])
            slope.scale[0] = (pull * self.seen[before]).sum(axis=0)
            slope.scale[1] = (pull * self.seen[last]).sum(axis=0)
            slope.bias[:] = np.bincount(word, true_pull[:, 0], CLASSES)
            slope.bias[:] += np.bincount(drawn, false_pull.sum(axis=0), CLASSES)
            seen += slope.flat**2
            self.flat += RATE * slope.flat / np.sqrt(seen + 1e-6)


def _add_rows(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """``out[index] += rows`` with repeated indices, by sums over runs of equal ones."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    out[index[first]] += np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def contexts(klass: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; a document's first tokens follow the start class."""
    last, before = np.full_like(klass, START), np.full_like(klass, START)
    last[1:], before[2:] = klass[:-1], klass[:-2]
    first = bounds[:-1]
    last[first] = before[first] = START
    second = first + 1
    before[second[second < bounds[1:]]] = START
    return before, last


def fit(docs: DataFrame, head: Head) -> LogBilinear:
    """Train on all tokens of ``docs``: in every round each task passes over its own, starting
    from the averages of the round before."""
    class_counts = head.class_counts()
    model = LogBilinear.start(class_counts)
    if not head.total:
        return model
    bodies = docs.select(text_bytes().alias("body"))
    for round_no in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((head, model.flat, class_counts / class_counts.sum()))
        trained = bodies.mapInArrow(_trainer(shared, round_no), "flat array<float>, seen long")
        means = (
            trained.select("seen", F.posexplode("flat").alias("at", "x"))
            .groupBy("at")
            .agg((F.sum(F.col("x").cast("double") * F.col("seen")) / F.sum("seen")).alias("x"))
            .toArrow()
        )
        flat = np.empty(LogBilinear.SIZE, dtype=np.float32)
        flat[means["at"].to_numpy()] = means["x"].to_numpy()
        model = LogBilinear(flat)
    return model


def _trainer(shared, round_no: int):
    def train(batches):
        head, flat, noise_p = shared.value
        model, slopes, n_tokens = LogBilinear(flat.copy()), np.zeros_like(flat), 0
        rng = np.random.default_rng([SEED, round_no, TaskContext.get().partitionId()])
        held, size = [], 0

        def learn():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            triples = np.stack([code // CLASSES**2, code // CLASSES % CLASSES, code % CLASSES], axis=1)
            model.train(triples, n, noise_p, rng, slopes)

        for batch in batches:
            for part in slices(batch.column("body")):
                found, bounds = tokens(part)
                klass = head.classes(found)
                before, last = contexts(klass, bounds)
                held.append((before * CLASSES + last) * CLASSES + klass)
                size += len(klass)
                n_tokens += len(klass)
                if size >= TRAIN_TOKENS:
                    learn()
                    held, size = [], 0
        if size:
            learn()
        if n_tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.flat.tolist()], pa.list_(pa.float32())), pa.array([n_tokens])], names=["flat", "seen"]
            )

    return train


SCORED = [
    ("row_id", T.LongType(), pa.int64()),
    ("n_tokens", T.LongType(), pa.int64()),
    ("known", T.LongType(), pa.int64()),
    ("logs", T.DoubleType(), pa.float64()),
    ("model_log", T.DoubleType(), pa.float64()),
    ("rare", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
]


class Scorer:
    """Scores slices with one model; norms of contexts are kept once computed."""

    def __init__(self, head: Head, model: LogBilinear):
        self.head, self.model = head, model
        self.norms = np.full(CLASSES * CLASSES, np.nan)
        self.other_logs = np.log10(head.other_norms())

    def norm(self, code: np.ndarray) -> np.ndarray:
        new = np.unique(code[np.isnan(self.norms[code])])
        if len(new):
            self.norms[new] = self.model.log_norms(new // CLASSES, new % CLASSES)
        return self.norms[code]

    def score(self, part: Slice):
        """Columns of ``SCORED`` after ``row_id``: log10 sums over tokens whose count is at
        hand, and the hashes of the rare words whose counts are not."""
        found, bounds = tokens(part)
        at, there = self.head.find(found)
        klass = self.head.classes(found)
        before, last = contexts(klass, bounds)
        model = self.model
        raw = (model.context(before, last) * model.next[klass]).sum(axis=1) + model.bias[klass]
        model_log = (raw - self.norm(before * CLASSES + last)) / np.log(10)
        logs = np.where(there, np.log10(self.head.count[at] + 1.0), 0.0) if len(self.head.word) else np.zeros(len(found))
        shared = klass < OTHERS
        model_log[shared] += logs[shared] - self.other_logs[klass[shared]]
        rare = np.flatnonzero(~there)
        offsets = np.searchsorted(rare, bounds).astype(np.int32)
        return [
            pa.array(np.diff(bounds)),
            pa.array(per_document(there.astype(np.int64), bounds, np.add, 0)),
            pa.array(per_document(logs, bounds, np.add, 0.0)),
            pa.array(per_document(model_log, bounds, np.add, 0.0)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(found[rare]))),
        ]


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Training texts are those not held out. A null or empty text is the end token alone.
    ``score`` is the log10 probability of all tokens under the model, which is normalised
    over all words: a word of the shared class has the class's probability times its
    smoothed share of the class's counts. Without training texts counts are zero and the
    model is uniform up to its start. Repeated rows are scored alike; an empty table gives
    no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    training = docs.where(~held_out())
    counts = pin(word_counts(training), "word-counts")
    head = frequent_words(counts)
    model = fit(training, head)
    shared = spark.sparkContext.broadcast((head, model.flat))
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(n, t) for n, t, _ in SCORED]]
    )

    def score(batches):
        own_head, flat = shared.value
        scorer = Scorer(own_head, LogBilinear(flat))
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch.column("body")):
                n = part.last - part.first
                own = batch.slice(part.first, n)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(np.arange(row_id, row_id + n)), *scorer.score(part)],
                    names=schema.names,
                )
                row_id += n

    scored = pin(
        docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("body")).mapInArrow(score, schema),
        "lm-scored",
    )
    rare_counts = counts.where(F.col("n") < head.least)
    rare = (
        scored.select("row_id", F.explode("rare").alias("word"))
        .join(rare_counts, "word")
        .groupBy("row_id")
        .agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    )
    base_norm = F.log10(F.lit(float(head.total + head.distinct + 1)))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.drop("rare").join(rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * base_norm).alias("base_score"),
        (F.col("model_log") + rare_logs).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir):
    return score_texts(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
