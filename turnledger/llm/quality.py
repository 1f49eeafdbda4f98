"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text, from counts that numpy takes over
many texts at once. Expectation-maximisation over the counts of vote patterns estimates how
often each labeller is right on good and on bad texts, and with that the posterior label of a
text. A linear scorer over hashed byte n-grams learns the posteriors and generalises to texts
the labellers pass over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.frames import prepare, text_bytes
from turnledger.llm.text import WHITESPACE, Slice, Words, byte_codes, per_document, slices, words

SYMBOLS = "#$%&*@|<>{}[]\\^~_=+!"
#: Marks that are neither letters nor faults.
PUNCTUATION = ".,;:-"

LABELLERS = (
    "symbols",
    "marked_words",
    "letters",
    "capitals",
    "repeated_words",
    "few_words",
    "repeated_lines",
    "sentences",
    "word_length",
    "digits",
    "length",
)

#: Votes: 0 bad, 1 good, 2 none.
BAD, GOOD, NONE = 0, 1, 2

BUCKETS = 1 << 11
FEATURES = BUCKETS + 1
ORDERS = 3
#: The scorer is fitted on about this many texts, chosen by hash, and at most twice as many.
SAMPLE = 4096
STEPS, RATE, DECAY = 400, 0.05, 1e-4
EM_ROUNDS = 100
THRESHOLD = 0.5
#: Bytes of text judged at once; features take a row of numbers for each of its texts.
PART_BYTES = 1 << 18
#: n-grams at which a text's own features count half.
EVIDENCE = 100


def _bytes(characters: str) -> np.ndarray:
    own = np.zeros(256, dtype=bool)
    own[list(characters.encode())] = True
    return own


_SYMBOL, _DIGIT, _MARK, _END = (_bytes(c) for c in (SYMBOLS, "0123456789", PUNCTUATION, ".?"))
_BLANK, _BREAK, _UPPER = _bytes(" \n"), _bytes("\n"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CODES = byte_codes(fold_case=False)


def _upper(data: np.ndarray) -> np.ndarray:
    """Capitals of ASCII and of Latin-1, the latter at the second of their two bytes."""
    own = _UPPER[data]
    own[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return own


def _distinct(found: Words) -> np.ndarray:
    """Distinct words of each document, by hashes cut to the bits the document leaves."""
    n = len(found.bounds) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), found.counts)
    key = np.sort((row << np.uint64(44)) | (found.hashes >> np.uint64(20)))
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def votes(part: Slice) -> np.ndarray:
    """Votes of the ``LABELLERS`` on each document. Texts without words get only the last."""
    data, offsets = part.data, part.offsets

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    chars = count((data & 0xC0) != 0x80)
    symbol = _SYMBOL[data]
    symbols, digits, ends, upper = count(symbol), count(_DIGIT[data]), count(_END[data]), count(_upper(data))
    blanks = count(_BLANK[data])
    letters = np.maximum(chars - symbols - digits - blanks - count(_MARK[data]), 1)
    found, lines = words(part, WHITESPACE, _CODES), words(part, _BREAK, _CODES)
    n_words, n_lines = found.counts, lines.counts
    with_symbol = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(symbol, out=with_symbol[1:])
    marked = per_document(
        (with_symbol[found.ends] > with_symbol[found.starts]).astype(np.int64), found.bounds, np.add, 0
    )
    per_char, per_word = np.maximum(chars, 1), np.maximum(n_words, 1)
    distinct, distinct_lines = _distinct(found) / per_word, _distinct(lines) / np.maximum(n_lines, 1)
    letter_share = letters / np.maximum(chars - blanks, 1)
    words_an_end, word_length = n_words / np.maximum(ends, 1), letters / per_word
    some, none = n_words >= 5, np.zeros(len(chars), dtype=bool)
    bad_good = {
        "symbols": (some & (symbols / per_char > 0.05), some & (symbols / per_char < 0.01)),
        "marked_words": (some & (marked / per_word > 0.2), some & (marked / per_word < 0.05)),
        "letters": (some & (letter_share < 0.85), some & (letter_share > 0.93)),
        "capitals": (some & (upper / letters > 0.5), some & (upper / letters < 0.2)),
        "repeated_words": ((n_words >= 20) & (distinct < 0.1), (n_words >= 20) & (distinct > 0.3)),
        "few_words": ((n_words >= 60) & (distinct < 0.2), (n_words >= 60) & (distinct > 0.25)),
        "repeated_lines": ((n_lines >= 3) & (distinct_lines < 0.5), (n_lines >= 3) & (distinct_lines > 0.9)),
        "sentences": ((n_words >= 40) & (words_an_end > 120), some & (words_an_end <= 40) & (ends > 0)),
        "word_length": (
            some & ((word_length > 14) | (word_length < 1.5)),
            some & (word_length >= 2.5) & (word_length <= 9),
        ),
        "digits": (some & (digits / per_char > 0.25), some & (digits / per_char < 0.02)),
        "length": (n_words < 1, none),
    }
    return np.stack([np.where(b, BAD, np.where(g, GOOD, NONE)) for b, g in map(bad_good.get, LABELLERS)], axis=1)


def wordless(patterns: np.ndarray, names: Sequence[str] = LABELLERS) -> np.ndarray:
    """Whether the votes of ``names`` are those on a text without words; never, if none of them tells."""
    if "length" not in names:
        return np.zeros(len(patterns), dtype=bool)
    return patterns[:, names.index("length")] == BAD


@dataclass
class LabelModel:
    """Share of good texts, and the probability of a good vote given a bad or a good text.

    Whether a labeller votes at all is taken to say nothing about the text.
    """

    names: list[str]
    good: float
    votes_good: np.ndarray

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """How often each labeller is right on bad and on good texts, when it votes."""
        return {n: (float(1 - v[0]), float(v[1])) for n, v in zip(self.names, self.votes_good, strict=True)}

    def ratios(self) -> np.ndarray:
        """Log odds that each vote adds: bad, good, none."""
        q = self.votes_good
        return np.stack([np.log((1 - q[:, 1]) / (1 - q[:, 0])), np.log(q[:, 1] / q[:, 0]), np.zeros(len(q))], axis=1)

    def prior(self) -> float:
        return float(np.log(self.good / (1 - self.good)))

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        return self.prior() + self.ratios()[np.arange(len(self.names)), patterns].sum(axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text is good; one without words is bad for certain."""
        out = 1 / (1 + np.exp(-np.clip(self.log_odds(patterns), -700, 700)))
        return np.where(wordless(patterns, self.names), 0.0, out)


def fit_labels(names: list[str], patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how often they occur.

    Starts from labellers that rarely object to a good text and overlook most faults of a
    bad one, each being made for one fault; this also fixes which side is good. The same
    rates, weighing a thousandth of the texts, keep labellers that seldom vote in bounds.
    """
    start = np.tile([0.7, 0.995], (len(names), 1))
    model = LabelModel(names, 0.8, start.copy())
    if not len(patterns):
        return model
    held = max(1.0, counts.sum() / 1000)
    for _ in range(EM_ROUNDS):
        good = model.posterior(patterns)
        for side, weight in enumerate(((1 - good) * counts, good * counts)):
            yes = weight @ (patterns == GOOD)
            no = weight @ (patterns == BAD)
            model.votes_good[:, side] = (yes + held * start[:, side]) / (yes + no + held)
        model.good = float(np.clip((good * counts).sum() / counts.sum(), 0.02, 0.98))
    return model


def grams(part: Slice):
    """For each order, the buckets of all byte n-grams and each document's bounds."""
    data, offsets = part.data.astype(np.uint32), part.offsets
    stop = np.repeat(offsets[1:], np.diff(offsets))
    code = np.zeros(len(data), dtype=np.uint32)
    for order in range(1, ORDERS + 1):
        code[: len(data) - order + 1] = code[: len(data) - order + 1] * np.uint32(257) + data[order - 1 :] + np.uint32(1)
        at = np.flatnonzero(np.arange(len(data)) + order <= stop)
        mixed = code[at] * np.uint32(2654435761)
        yield (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), np.searchsorted(at, offsets)


def features(part: Slice) -> np.ndarray:
    """Square roots of the n-gram shares of each document, and how far few n-grams prevail.

    Short texts say little: all their features are less.
    """
    n = part.last - part.first
    out = np.zeros((n, BUCKETS))
    for bucket, bounds in grams(part):
        row = np.repeat(np.arange(n), np.diff(bounds))
        out += np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = np.maximum(out.sum(axis=1, keepdims=True), 1)
    share = out / total
    prevail = np.sqrt((share**2).sum(axis=1, keepdims=True))
    own = np.concatenate([np.sqrt(share), prevail], axis=1)
    return (own * (total / (total + EVIDENCE))).astype(np.float32)


@dataclass
class LinearScorer:
    weight: np.ndarray
    bias: float

    def score(self, part: Slice) -> np.ndarray:
        out = features(part).astype(np.float64) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit_scorer(x: np.ndarray, y: np.ndarray, prior: float) -> LinearScorer:
    """Logistic regression on soft labels, Adam on the full batch.

    The bias stays at the prior log odds, which a text without evidence gets.
    """
    weight, bias = np.zeros(FEATURES), prior
    if not len(y):
        return LinearScorer(weight, bias)
    first, second = np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weight.astype(np.float32) + bias, -40, 40)))
        error = ((p - y) / len(y)).astype(np.float32)
        slope = x.T @ error + DECAY * weight
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weight = weight - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return LinearScorer(weight, bias)


def _count_patterns(batches):
    """How often each vote pattern occurs in a partition, a pattern written in base 3."""
    base = 3 ** np.arange(len(LABELLERS))
    totals: dict[int, int] = {}
    for batch in batches:
        for part in slices(batch.column("body"), PART_BYTES):
            for code, n in zip(*np.unique(votes(part) @ base, return_counts=True), strict=True):
                totals[int(code)] = totals.get(int(code), 0) + int(n)
    yield pa.RecordBatch.from_pydict(
        {"pattern": pa.array(list(totals), pa.int64()), "n": pa.array(list(totals.values()), pa.int64())}
    )


def _sampled(labels: LabelModel):
    def rows(batches):
        for batch in batches:
            for part in slices(batch.column("body"), PART_BYTES):
                x = pa.array(features(part).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(labels.posterior(votes(part))),
                        pa.FixedSizeListArray.from_arrays(x, FEATURES).cast(pa.list_(pa.float32())),
                    ],
                    names=["posterior", "x"],
                )

    return rows


def train(docs: DataFrame) -> tuple[LabelModel, LinearScorer]:
    """The label model from the vote patterns of all texts, and the scorer from a bounded sample.

    At most ``3 ** labellers`` pattern counts and ``2 * SAMPLE`` feature rows reach the driver.
    """
    bodies = docs.select(text_bytes().alias("body"))
    found = bodies.mapInArrow(_count_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    code, counts = found["pattern"].to_numpy(), found["n"].to_numpy().astype(np.float64)
    patterns = code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    labels = fit_labels(list(LABELLERS), patterns, counts)
    share = min(1.0, SAMPLE / max(counts.sum(), 1.0))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(int(np.ceil(share * (1 << 20))))
    sample = (
        docs.where(chosen)
        .limit(2 * SAMPLE)
        .select(text_bytes().alias("body"))
        .mapInArrow(_sampled(labels), "posterior double, x array<float>")
        .toArrow()
    )
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    return labels, fit_scorer(x, sample["posterior"].to_numpy(), labels.prior())


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_votes, posterior, score, kept``.

    ``posterior`` is the label model's probability that the text is good, ``score`` the
    linear scorer's; ``kept`` is a score of at least one half. Null, empty and
    blank texts have posterior and score 0. Texts are read whole, a few times their size in
    memory. Repeated rows are scored alike, an empty table gives no rows, other columns
    are ignored.
    """
    prepare(docs.sparkSession)
    labels, scorer = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((labels, scorer))

    @F.arrow_udf("n_votes int, posterior double, score double")
    def judge(bodies: pa.Array) -> pa.Array:
        own_labels, own_scorer = shared.value
        columns = [[np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(0)]]
        for part in slices(bodies, PART_BYTES):
            cast = votes(part)
            columns[0].append((cast != NONE).sum(axis=1).astype(np.int32))
            columns[1].append(own_labels.posterior(cast))
            columns[2].append(np.where(wordless(cast), 0.0, own_scorer.score(part)))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(c)) for c in columns], names=["n_votes", "posterior", "score"]
        )

    return (
        docs.select("doc_id", judge(text_bytes()).alias("found"))
        .select("doc_id", "found.*")
        .withColumn("kept", F.col("score") >= THRESHOLD)
    )


def op3_quality_classifier(spark, sf_dir):
    return classify(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
