"""Toxicity from a learned lexicon, misspellings of its terms and the context of each place.

The lexicon holds the words that toxic training texts have far more often than clean ones, in
contexts of their own: a word that comes back between the same neighbours is a copied
passage, not a habit. Levenshtein automata of a text's words are intersected with the trie of
the lexicon, so misspelled terms are found too. A window of words around each place tells
quotation from abuse: quote marks and words of reporting against words that address someone.
What a term at a distance in a context says about a text is learned from the training rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.edit_trie import EditTrie
from turnledger.llm.frames import crc_of_id, pin, prepare, text_bytes
from turnledger.llm.text import Slice, Words, byte_codes, mix, slices, words

HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 5, 0
#: Labelled rows the model is fitted on, about; at most twice as many.
SAMPLE = 1 << 18
#: Terms of the lexicon at most; those that tell most are taken.
MAX_TERMS = 4096
MIN_LETTERS, MAX_LETTERS = 3, 40
#: A term's share of toxic texts over its share of clean ones, and its contexts over its texts, at least.
LIFT, FRESH = 4.0, 0.2
#: Words before and after a place that make its context.
WINDOW = 5
#: Words remembered by a worker with their nearest term.
REMEMBERED = 1 << 20
SLICE = 4 << 20
THRESHOLD = 0.5

PLAIN, QUOTED, ADDRESSED = 0, 1, 2
#: Share of toxic texts among those with a term at a distance, before any is seen (counts as one text).
TOXIC_SHARE = (0.98, 0.9, 0.6)
#: What a text with a term at one edit says of those at two edits, and the other way round.
NEIGHBOUR = 0.1
#: Weight of a place by context before anything is learned, and texts that outweigh it.
CONTEXT_WEIGHT, CONTEXT_TEXTS = (1.0, 0.35, 1.2), 20
DISTANCES = 3

# Words of reporting, and words that address someone.
REPORTING = (
    "said says saying called calls calling quote quoted quotes quoting wrote writes word words term phrase "
    "sagte sagt nannte genannt schrieb zitat zitiert wort begriff "
    "dit disait appelé écrit cite citation mot terme "
    "dijo dice llamó llamado escribió cita citado palabra término"
).split()
ADDRESSING = (
    "you your yours yourself youre ya u du dich dir dein deine ihr euch sie "
    "tu toi te ton ta tes vous votre vos tú ti tus usted ustedes eres sois"
).split()

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[128:] = False
_SEPARATOR[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_CODES = byte_codes(fold_case=True)
#: Quote marks beyond ASCII, as the bytes that stand for them (of equal length, so that places stay).
_MARKS = {"“": b' " ', "”": b' " ', "„": b' " ', "«": b'" ', "»": b' "'}


def _plain(part: Slice) -> Slice:
    body = part.data.tobytes()
    for mark, ascii_form in _MARKS.items():
        body = body.replace(mark.encode(), ascii_form)
    return Slice(part.first, part.last, np.frombuffer(body, dtype=np.uint8), part.offsets)


def _word_keys(own: list[str]) -> np.ndarray:
    bodies = pa.array([w.encode() for w in own], pa.binary())
    return np.sort(np.concatenate([words(p, _SEPARATOR, _CODES).hashes for p in slices(bodies)]))


_REPORTING, _ADDRESSING = _word_keys(REPORTING), _word_keys(ADDRESSING)


def _among(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def read_words(part: Slice) -> tuple[Slice, Words, np.ndarray]:
    """The slice with plain quote marks, its words, and the document of each."""
    part = _plain(part)
    found = words(part, _SEPARATOR, _CODES)
    return part, found, np.repeat(np.arange(len(found.counts)), found.counts)


def contexts(part: Slice, found: Words, document: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``PLAIN``, ``QUOTED`` or ``ADDRESSED`` for the words ``at``.

    A place is quoted if its window has a quote mark on both sides, or a word of reporting up
    to ``WINDOW`` words before it; else addressed if the window has a word that addresses.
    """
    low = np.maximum(at - WINDOW, found.bounds[document[at]])
    high = np.minimum(at + WINDOW, found.bounds[document[at] + 1] - 1)

    def sums(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    # Marks next to the outer words of the window belong to it, unless another document begins there.
    marks = sums(part.data == ord('"'))
    first = np.maximum(found.starts[low] - 1, part.offsets[document[at]])
    last = np.minimum(found.ends[high] + 1, part.offsets[document[at] + 1])
    before = marks[found.starts[at]] - marks[first]
    after = marks[last] - marks[found.ends[at]]
    reporting, addressing = sums(_among(found.hashes, _REPORTING)), sums(_among(found.hashes, _ADDRESSING))
    quoted = ((before > 0) & (after > 0)) | (reporting[at] > reporting[low])
    addressed = addressing[high + 1] > addressing[low]
    return np.where(quoted, QUOTED, np.where(addressed, ADDRESSED, PLAIN))


def training_words(rows: DataFrame) -> DataFrame:
    """``word, contexts, toxic, clean``: texts that hold each word, and its distinct neighbours in toxic ones."""

    def count(batches):
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            for part in slices(batch["body"], SLICE):
                part, found, document = read_words(part)
                if not len(document):
                    continue
                padded = np.concatenate([[0], found.hashes, [0]]).astype(np.uint64)
                edge = np.concatenate([[True], document[1:] != document[:-1], [True]])
                left = np.where(edge[:-1], np.uint64(1), padded[:-2])
                right = np.where(edge[1:], np.uint64(1), padded[2:])
                order = np.lexsort((found.hashes, document))
                fresh = np.zeros(len(order), dtype=bool)
                fresh[order[0]] = True
                fresh[order[1:]] = (found.hashes[order[1:]] != found.hashes[order[:-1]]) | (
                    document[order[1:]] != document[order[:-1]]
                )
                bad = toxic[part.first : part.last][document]
                at = np.flatnonzero(bad)
                yield _training_rows(
                    found.hashes[at],
                    [part.data[a:b].tobytes().lower() for a, b in zip(found.starts[at], found.ends[at], strict=True)],
                    mix(left[at] * np.uint64(3) + right[at]) | np.uint64(1),
                    fresh[at].astype(np.int64),
                    np.zeros(len(at), dtype=np.int64),
                )
                key, n = np.unique(found.hashes[~bad & fresh], return_counts=True)
                nothing = np.zeros(len(key), dtype=np.int64)
                yield _training_rows(key, [None] * len(key), nothing.astype(np.uint64), nothing, n)

    return (
        rows.mapInArrow(count, "key long, word string, context long, toxic long, clean long")
        .groupBy("key", "context")
        .agg(F.max("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .groupBy("key")
        .agg(
            F.max("word").alias("word"),
            F.count_if(F.col("context") != 0).alias("contexts"),
            F.sum("toxic").alias("toxic"),
            F.sum("clean").alias("clean"),
        )
    )


def _training_rows(key, word, context, toxic, clean) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)),
            pa.array(word, pa.binary()).cast(pa.string()),
            pa.array(context.view(np.int64)),
            pa.array(toxic),
            pa.array(clean),
        ],
        names=["key", "word", "context", "toxic", "clean"],
    )


def learn_lexicon(counts: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Terms whose toxic share chance does not explain, those that tell most first.

    A word's evidence is Chernoff's bound on the chance that so many of its texts are toxic;
    words are taken until less than one is expected to be there by chance.
    """
    if not n_toxic or not n_clean:
        return []
    n_words = counts.where("toxic > 0").count()
    usual = n_toxic / (n_toxic + n_clean)
    hits = F.least("contexts", "toxic").cast("double")
    share = hits / (hits + F.col("clean"))
    gain = hits * F.log(share / F.lit(usual)) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - share) / F.lit(1 - usual))
    ).otherwise(0.0)
    lift = (hits / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    length = F.char_length("word")
    return [
        r["word"]
        for r in counts.where((F.col("toxic") > 0) & length.between(MIN_LETTERS, MAX_LETTERS))
        .where((F.col("contexts") >= FRESH * F.col("toxic")) & (lift >= LIFT) & (share > usual))
        .withColumn("gain", gain)
        .where(F.col("gain") >= math.log(max(n_words, 2)))
        .orderBy(F.desc("gain"), "word")
        .limit(MAX_TERMS)
        .select("word")
        .collect()
    ]


@dataclass
class Finder:
    """Places of lexicon terms; the nearest term of each distinct word is remembered."""

    trie: EditTrie
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))

    def _learn(self, part: Slice, found: Words) -> None:
        keys, first = np.unique(found.hashes, return_index=True)
        if len(self.keys):
            new = ~_among(keys, self.keys)
            keys, first = keys[new], first[new]
        if not len(keys):
            return
        bodies = [
            part.data[a:b].tobytes().lower().decode("utf-8", "replace")
            for a, b in zip(found.starts[first], found.ends[first], strict=True)
        ]
        term, distance = self.trie.match(bodies)
        code = np.where(term >= 0, term * DISTANCES + distance, -1).astype(np.int32)
        if len(self.keys) + len(keys) > REMEMBERED:
            used = np.unique(found.hashes)
            held = np.isin(self.keys, used)
            self.keys, self.codes = self.keys[held], self.codes[held]
        self.keys, self.codes = np.concatenate([self.keys, keys]), np.concatenate([self.codes, code])
        order = np.argsort(self.keys)
        self.keys, self.codes = self.keys[order], self.codes[order]

    def places(self, part: Slice) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and kinds (term, distance and context as one number) of all places."""
        part, found, document = read_words(part)
        n = len(found.counts)
        if not len(document) or not self.trie.terms:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), n
        self._learn(part, found)
        code = self.codes[np.searchsorted(self.keys, found.hashes)]
        at = np.flatnonzero(code >= 0)
        kind = code[at].astype(np.int64) * 3 + contexts(part, found, document, at)
        return document[at], kind, n


def training_places(rows: DataFrame, lexicon: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean texts (one row each) by kind of place, and last those without a place.

    Misspelled places count in texts without a correctly spelled term only: beside one, they
    say nothing of their own.
    """
    n_kinds = len(lexicon) * DISTANCES * 3

    def count(batches):
        finder = Finder(EditTrie(lexicon))
        sums = np.zeros((2, n_kinds + 1), dtype=np.int64)
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
            for part in slices(batch["body"], SLICE):
                document, kind, n = finder.places(part)
                own = toxic[part.first : part.last]
                exact = kind // 3 % DISTANCES == 0
                spelled = np.zeros(n, dtype=bool)
                spelled[document[exact]] = True
                told = exact | ~spelled[document]
                pair = np.unique(document[told] * n_kinds + kind[told])
                np.add.at(sums, (own[pair // n_kinds], pair % n_kinds), 1)
                without = np.ones(n, dtype=bool)
                without[document] = False
                sums[:, n_kinds] += np.bincount(own[without], minlength=2)
        for label in (0, 1):
            held = np.flatnonzero(sums[label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), label)), pa.array(held), pa.array(sums[label, held])],
                names=["toxic", "kind", "n"],
            )

    table = (
        rows.mapInArrow(count, "toxic long, kind long, n long")
        .groupBy("toxic", "kind")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros((2, n_kinds + 1), dtype=np.int64)
    out[table["toxic"].to_numpy(), table["kind"].to_numpy()] = table["n"].to_numpy()
    return out[1], out[0]


@dataclass
class Model:
    """``gains`` are the log odds that a kind of place adds to ``prior``; ``without`` those of having none."""

    lexicon: list[str]
    gains: np.ndarray
    prior: float
    without: float

    @staticmethod
    def fit(lexicon: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Model:
        """Toxic share of the texts with a term at a distance, smoothed, and weighted by context."""
        shape = (len(lexicon), DISTANCES, 3)
        t, c = toxic[:-1].reshape(shape), clean[:-1].reshape(shape)
        prior = math.log((n_toxic + 1) / (n_clean + 9))
        t_all, c_all = t.sum(axis=2).astype(float), c.sum(axis=2).astype(float)
        t_all[:, 1:] += NEIGHBOUR * t_all[:, :0:-1]
        c_all[:, 1:] += NEIGHBOUR * c_all[:, :0:-1]
        share = (t_all + np.array(TOXIC_SHARE)) / (t_all + c_all + 1)
        gains = np.log(share / (1 - share)) - prior
        exact_t, exact_c = t[:, 0].sum(axis=0), c[:, 0].sum(axis=0)
        told = np.log((exact_t + 1) / (exact_c + 1)) - prior
        weight = np.array(CONTEXT_WEIGHT)
        if told[PLAIN] > 0:
            seen = exact_t + exact_c
            weight = (weight * CONTEXT_TEXTS + np.clip(told / told[PLAIN], 0, 1.5) * seen) / (CONTEXT_TEXTS + seen)
        without = math.log((toxic[-1] + 1) / (clean[-1] + 9)) - prior
        return Model(lexicon, (gains[:, :, None] * weight).reshape(-1), prior, min(without, 0.0))

    def judge(self, document: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of distinct kinds of places, and strongest term (or -1) of each of ``n`` texts.

        Terms spelled as in the lexicon add up; of misspelled ones only the strongest counts,
        since accidents grow with a text's length.
        """
        n_kinds = max(len(self.gains), 1)
        pair = np.unique(document * n_kinds + kind)
        own, kind = pair // n_kinds, pair % n_kinds
        odds, nearly = np.zeros(n), np.full(n, -np.inf)
        count, best = np.bincount(own, minlength=n), np.full(n, -1, dtype=np.int64)
        if len(pair):
            gain = self.gains[kind]
            exact = kind // 3 % DISTANCES == 0
            np.add.at(odds, own[exact], gain[exact])
            np.maximum.at(nearly, own[~exact], gain[~exact])
            order = np.lexsort((-kind, gain, own))
            last = order[np.append(own[order][1:] != own[order][:-1], True)]
            best[own[last]] = kind[last] // (3 * DISTANCES)
        odds += np.where(np.isfinite(nearly), nearly, 0) + self.prior + np.where(count == 0, self.without, 0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30))), count, best


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``body, toxic`` of the training rows; a document with several labels is toxic if one says so.

    Labels are chosen by a hash of the id, about ``SAMPLE`` of them and at most twice as many, so
    that they can be sent to the texts: texts are never shuffled.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
        .where(crc_of_id() % HELD_OUT_MODULUS != HELD_OUT_REMAINDER)
    )
    known = pin(known, "toxicity-labels")
    share = min(1.0, SAMPLE / max(known.count(), 1))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))
    known = known.where(chosen).limit(2 * SAMPLE)
    rows = docs.where(crc_of_id() % HELD_OUT_MODULUS != HELD_OUT_REMAINDER)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.join(F.broadcast(pin(known, "toxicity-sample")), "doc_id").select("body", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the training rows; without toxic or without clean ones it has no lexicon."""
    rows = labelled_rows(docs, labels)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    lexicon = []
    if n_toxic and n_clean:
        lexicon = learn_lexicon(pin(training_words(rows), "toxicity-words"), n_toxic, n_clean)
    if not lexicon:
        return Model([], np.zeros(0), math.log((n_toxic + 1) / (n_clean + 9)), 0.0)
    toxic, clean = training_places(rows, lexicon)
    return Model.fit(lexicon, toxic, clean, n_toxic, n_clean)


RESULT = "score double, n_terms long, term string"


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, n_terms, term``.

    ``n_terms`` counts the distinct kinds of places, ``term`` is the strongest lexicon term met.
    Null, empty and blank texts have no places and get the score of such texts. Without labels
    of both kinds every text gets the share of toxic training rows, drawn to a tenth. Repeated
    rows are scored alike, and of equally strong terms the one that tells more in training is
    named. Texts are read whole, a few times their size in memory. A null id counts as empty for
    ``held_out``. An empty table gives no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(learn(docs, labels))
    held: list[Finder] = []

    @F.arrow_udf(RESULT)
    def judge(bodies: pa.Array) -> pa.Array:
        model = sent.value
        if not held:
            held.append(Finder(EditTrie(model.lexicon)))
        names = pa.array(model.lexicon, pa.string())
        scores, counts, terms = [], [], []
        for part in slices(bodies, SLICE):
            score, count, best = model.judge(*held[0].places(part))
            scores.append(score)
            counts.append(count)
            terms.append(best)
        score, count, best = (np.concatenate(c) if c else np.zeros(0) for c in (scores, counts, terms))
        best = pa.array(best.astype(np.int64), mask=best < 0)
        return pa.StructArray.from_arrays(
            [pa.array(score.astype(np.float64)), pa.array(count.astype(np.int64)), names.take(best)],
            names=["score", "n_terms", "term"],
        )

    found = docs.select(
        F.col("doc_id"), (crc_of_id() % HELD_OUT_MODULUS == HELD_OUT_REMAINDER).alias("held_out"),
        judge(text_bytes()).alias("found"),
    )
    return found.select(
        "doc_id", "held_out", "found.score",
        (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), "found.n_terms", "found.term",
    )


def op13_toxicity(spark, sf_dir):
    read = prepare(spark).read
    return score_toxicity(read.parquet(f"{sf_dir}/documents.parquet"), read.parquet(f"{sf_dir}/labels.parquet"))
