"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become sequences of lower-case letters with one space for every run of other
characters. All n-grams of one to three symbols are hashed into buckets; buckets are
counted per language over all training texts. The matrix of log probabilities is broadcast,
and batches are scored by summing its rows over the n-grams a document has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.frames import boxed, crc_of_id, prepare, text_bytes, unboxed
from turnledger.llm.text import Slice, slices

ORDERS = 3
MAX_BUCKETS = 1 << 15
#: Cells of the broadcast matrix; with very many languages the buckets get fewer.
MAX_CELLS = 1 << 22
SMOOTHING = 0.1
UNDETERMINED = "und"
#: The pipeline drops undetermined texts and those whose best language is less sure than this.
MIN_SCORE = 0.3
FOLDS, HELD_OUT_FOLD = 4, 2
#: Cells of the counts and of the sums of documents scored together.
PART_CELLS = 1 << 22
#: Bytes of text turned into symbols at once; a symbol takes some sixty bytes meanwhile.
PART_BYTES = 1 << 19

_SPACE = 0x20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Per code point, whether it is alphabetic; built once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def symbols(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a slice and the bounds of its documents; each document starts with a space."""
    texts = [" " + part.document(i).decode("utf-8", "replace").lower() for i in range(part.last - part.first)]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[starts[:-1]] = True
    out = np.where(letter, codes, np.uint32(_SPACE))[kept]
    bounds = np.zeros(len(starts), dtype=np.int64)
    bounds[1:] = np.cumsum(kept)[starts[1:] - 1]
    return out, bounds


def buckets(part: Slice, n_buckets: int):
    """For each order, the buckets of all n-grams and the bounds of the documents' n-grams."""
    found, bounds = symbols(part)
    wide = found.astype(np.uint64)
    shift = np.uint64(64 - int(n_buckets).bit_length() + 1)
    index = np.arange(len(found))
    stop = np.repeat(bounds[1:], np.diff(bounds))
    for order in range(1, ORDERS + 1):
        fits = index + order <= stop
        if order == 1:
            fits &= found != _SPACE
        at = np.flatnonzero(fits)
        code = np.full(len(at), order, dtype=np.uint64) * _SPREAD
        for k in range(order):
            code += wide[at + k] * _FACTORS[k]
        code ^= code >> np.uint64(29)
        code *= _SPREAD
        yield (code >> shift).astype(np.int64), np.searchsorted(at, bounds)


def _counter(n_buckets: int):
    """Counts of a partition: a row per language and bucket; bucket -1 counts documents."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for part in slices(batch.column("body"), PART_BYTES):
                own = languages[part.first : part.last]
                names = sorted(set(own))
                code = np.array([names.index(x) for x in own])
                counts = np.zeros((len(names), n_buckets + 1), dtype=np.int64)
                counts[:, n_buckets] = np.bincount(code, minlength=len(names))
                for bucket, bounds in buckets(part, n_buckets):
                    row = np.repeat(code, np.diff(bounds))
                    flat = np.bincount(row * n_buckets + bucket, minlength=len(names) * n_buckets)
                    counts[:, :n_buckets] += flat.reshape(len(names), n_buckets)
                for i, name in enumerate(names):
                    totals[name] = totals[name] + counts[i] if name in totals else counts[i]
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(at), pa.string()),
                    pa.array(np.where(at == n_buckets, -1, at).astype(np.int32)),
                    pa.array(counts[at]),
                ],
                names=["lang", "bucket", "n"],
            )

    return count


@dataclass
class LanguageModel:
    """Languages by code point, their log priors, and log probabilities of the buckets."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray

    @property
    def n_buckets(self) -> int:
        return len(self.logs)

    def score(self, part: Slice) -> tuple[list[str], np.ndarray]:
        """Most probable language and its posterior probability for each document."""
        n = part.last - part.first
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        held = list(buckets(part, self.n_buckets))
        lettered = np.any([np.diff(bounds) > 0 for _, bounds in held], axis=0)
        best, sure = np.zeros(n, dtype=np.int64), np.zeros(n)
        n_languages = len(self.languages)
        few = n_languages * max(n, *(len(bucket) for bucket, _ in held)) <= PART_CELLS
        step = n if few else max(1, PART_CELLS // max(n_languages, self.n_buckets))
        for first in range(0, n, step):
            own = slice(first, min(first + step, n))
            sums = self.prior + (self.looked_up(held, n) if few else self.counted(held, own.start, own.stop))
            best[own] = sums.argmax(axis=1)
            sums -= sums.max(axis=1, keepdims=True)
            sure[own] = np.where(lettered[own], 1.0 / np.exp(sums).sum(axis=1), 0.0)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
        return names, sure

    def looked_up(self, held, n: int) -> np.ndarray:
        """Sums over the n-grams of ``n`` documents, taking one row of the matrix for each n-gram."""
        sums = np.zeros((n, len(self.languages)))
        for bucket, bounds in held:
            full = np.flatnonzero(np.diff(bounds) > 0)
            if len(full):
                sums[full] += np.add.reduceat(self.logs[bucket], bounds[full], axis=0, dtype=np.float64)
        return sums

    def counted(self, held, first: int, last: int) -> np.ndarray:
        """The same sums for documents ``first`` to ``last``, counting n-grams by bucket before.

        Memory is bounded by documents times buckets or languages, whatever the number of n-grams.
        """
        counts = np.zeros((last - first) * self.n_buckets)
        for bucket, bounds in held:
            a, b = bounds[first], bounds[last]
            row = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
            counts += np.bincount(row * self.n_buckets + bucket[a:b], minlength=len(counts))
        return counts.reshape(last - first, self.n_buckets) @ self.logs.astype(np.float64)


def train(docs: DataFrame) -> LanguageModel:
    """Count all rows of ``docs`` with a language; null texts count as empty.

    The number of buckets follows the number of languages, so that the model has at most
    ``MAX_CELLS`` cells whatever the table holds.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), text_bytes().alias("body")
    )
    n_languages = known.agg(F.countDistinct("lang").alias("n")).first()["n"]
    n_buckets = MAX_BUCKETS
    while n_buckets > 1 and n_buckets * n_languages > MAX_CELLS:
        n_buckets //= 2
    found = (
        known.mapInArrow(_counter(n_buckets), "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    place = {name: i for i, name in enumerate(languages)}
    column = np.array([place[name] for name in names], dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts = np.zeros((n_buckets, len(languages)))
    documents = np.zeros(len(languages))
    grams = bucket >= 0
    counts[bucket[grams], column[grams]] = n[grams]
    documents[column[~grams]] = n[~grams]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * n_buckets)
    prior = np.log(documents / max(documents.sum(), 1.0))
    return LanguageModel(languages, prior, logs.astype(np.float32))


def predictor(docs: DataFrame, model: LanguageModel):
    """Column function: UTF-8 text to ``struct<lang_pred, score>``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(body: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for part in slices(body, PART_BYTES):
            some, sure = shared.value.score(part)
            names += some
            scores.append(sure)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"]
        )

    return predict


def held_out() -> Column:
    return crc_of_id() % FOLDS == HELD_OUT_FOLD


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from the folds that are not held out. ``score`` is the posterior probability; a
    null text or one without a letter is ``und`` with score 0, as is every text if there is
    nothing to learn from. Ties go to the first language by code point. Repeated rows are
    scored alike, an empty table gives no rows, other columns are ignored.
    """
    model = train(docs.where(~held_out()))
    predict = predictor(docs, model)
    return docs.select("doc_id", held_out().alias("held_out"), predict(text_bytes()).alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs``, all columns, without texts of no or of too unsure a language."""
    model = train(docs.where(~held_out()))
    predict = predictor(docs, model)
    tagged = boxed(docs).select("row", predict(text_bytes("row.text")).alias("found"))
    sure = (F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= min_score)
    return unboxed(tagged.where(sure))


def op10_language_id(spark, sf_dir):
    return identify(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
