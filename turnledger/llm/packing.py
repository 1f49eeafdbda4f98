"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents become token pieces of at most one sequence. Pieces are dealt at random to
partitions of a fixed size, each packed by best-fit decreasing. Dual feasible functions give
a lower bound on the sequences a partition needs; where the packing is above it, the
sequences with room are taken apart, their pieces are exchanged between partitions and
packed again, until the bound of all pieces is met or nothing is gained.
"""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.llm.frames import pin, prepare, text_bytes
from turnledger.llm.text import WHITESPACE, Slice, byte_codes, per_document, slices, words

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 4096
MAX_ROUNDS = 8
#: Word spellings a worker remembers before it starts anew.
CACHE_WORDS = 2_000_000

_SPECIAL = b"<|"
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b",.;:!?|")] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts, each distinct word spelled out once per worker.

    The tokenizer folds case and splits at white space and before a mark that follows a
    letter, so a text's ids are those of its words in turn. Texts that may contain the
    spelling of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if _PLAIN.fullmatch(chr(c))]
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        self.codes = byte_codes(fold_case=True)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def spell(self, word: str) -> list[int]:
        if _PLAIN.fullmatch(word):
            return [t.id for t in self.tokenizer.model.tokenize(word.lower().translate(self.letters))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, spellings: list[str]) -> None:
        found = [self.spell(w) for w in spellings]
        length = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.array([i for x in found for i in x], dtype=np.uint32)
        first = len(self.ids) + np.cumsum(length) - length
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.length = np.insert(self.length, at, length)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with the end id after each, and the documents' bounds."""
        data = part.data
        cuts = np.zeros(len(data), dtype=bool)
        cuts[1:] = _STOPS[data[1:]] & _ASCII_LETTER[data[:-1]]
        found = words(part, WHITESPACE, self.codes, cuts)
        distinct, sample, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            spelled = [
                data[found.starts[i] : found.ends[i]].tobytes().decode("utf-8", "replace") for i in sample[new]
            ]
            self._learn(distinct[new], spelled)
            at = np.searchsorted(self.known, distinct)
        place = at[inverse]
        length = self.length[place]
        own = per_document(length, found.bounds, np.add, 0) + 1
        bounds = np.zeros(len(own) + 1, dtype=np.int64)
        np.cumsum(own, out=bounds[1:])
        total = int(length.sum())
        source = np.repeat(self.first[place] - (np.cumsum(length) - length), length) + np.arange(total)
        out = np.full(bounds[-1], END_ID, dtype="<u4")
        inner = np.ones(bounds[-1], dtype=bool)
        inner[bounds[1:] - 1] = False
        out[inner] = self.ids[source]
        return out, bounds

    def documents(self, part: Slice):
        """Id array of each document of a slice."""
        out, bounds = self.encode(part)
        special = part.data.tobytes().find(_SPECIAL) >= 0
        for i in range(part.last - part.first):
            if special and _SPECIAL in (body := part.document(i)):
                ids = self.tokenizer.encode(body.decode("utf-8", "replace"), add_special_tokens=False).ids
                yield np.array([*ids, END_ID], dtype="<u4")
            else:
                yield out[bounds[i] : bounds[i + 1]]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One per worker and file, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECE_FIELDS = [
    ("piece", T.IntegerType(), pa.int32()),
    ("start", T.LongType(), pa.int64()),
    ("length", T.LongType(), pa.int64()),
    ("ids_crc32", T.LongType(), pa.int64()),
    ("row_id", T.LongType(), pa.int64()),
]


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Token pieces of every document; ``row_id`` is unique once the frame is written."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t, _ in PIECE_FIELDS]])

    def cut(batches):
        tokenizer = tokenizer_of(path)
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch.column("body")):
                origin, rows = [], []
                for i, ids in enumerate(tokenizer.documents(part)):
                    for number, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        origin.append(part.first + i)
                        rows.append((number, start, len(own), zlib.crc32(own.tobytes()), row_id))
                        row_id += 1
                columns = [batch.column("doc_id").take(pa.array(origin, pa.int64()))]
                columns += [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), PIECE_FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[n for n, _, _ in PIECE_FIELDS]])

    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """Sequences that any packing needs, before rounding up: the best of two families of
    dual feasible functions over the distinct lengths."""
    if len(lengths) == 0:
        return 0.0
    best = float((lengths * counts).sum()) / capacity
    for k in range(1, 20):
        scaled = (k + 1) * lengths
        value = np.where(scaled % capacity == 0, lengths * k, scaled // capacity * capacity)
        best = max(best, float((value * counts).sum()) / (k * capacity))
    for small in np.unique(np.append(lengths[lengths <= capacity // 2], 1)):
        value = np.where(lengths > capacity - small, capacity, np.where(lengths < small, 0, lengths))
        best = max(best, float((value * counts).sum()) / capacity)
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the room left in each bin.

    Bins are kept by their room; the lowest set bit of a mask is the tightest that fits.
    """
    place, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, room = 0, []
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = by_room[left].pop()
            if not by_room[left]:
                mask ^= 1 << left
        else:
            at, left = len(room), capacity
            room.append(capacity)
        place[i], offset[i] = at, capacity - left
        room[at] = left - need
        by_room[left - need].append(at)
        mask |= 1 << (left - need)
    return place, offset, np.array(room, dtype=np.int64)


def _packer(capacity: int, round_no: int, columns: list[str]):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        lengths = table["length"].to_numpy()
        place, offset, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(*np.unique(lengths, return_counts=True), capacity)
        # Met bound: the partition is certified. Else sequences with room go into the exchange.
        loose = (room >= capacity // 64) & (gap > 1e-9)
        sequence = (round_no << 56) + (key[0].as_py() << 24) + place
        out = table.select(columns)
        out = out.append_column("sequence_id", pa.array(sequence))
        out = out.append_column("offset", pa.array(offset))
        return out.append_column("loose", pa.array(loose[place]))

    return pack


def _groups(rows: int) -> int:
    return max(1, -(-rows // GROUP_PIECES))


def pack_pieces(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``found`` must be written data.

    At most ``capacity`` row counts, one per length, and a few totals reach the driver.
    """
    columns = found.columns
    counts = found.groupBy("length").count().toArrow()
    need = int(np.ceil(lower_bound(counts["length"].to_numpy(), counts["count"].to_numpy(), capacity) - 1e-9))
    schema = T.StructType(
        [
            *found.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("loose", T.BooleanType()),
        ]
    )
    rows, n_rows = found, int(sum(counts["count"].to_pylist()))
    settled, done_bins, open_bins, before = [], 0, None, None
    for round_no in range(MAX_ROUNDS):
        n_groups = _groups(n_rows)
        group = F.pmod(F.xxhash64(F.lit(round_no), "row_id"), F.lit(n_groups)).alias("group")
        packed = pin(
            rows.groupBy(group).applyInArrow(_packer(capacity, round_no, columns), schema), f"packed-{round_no}"
        )
        opens = F.col("offset") == 0
        bins = packed.agg(
            F.count_if(opens).alias("all"),
            F.count_if(opens & F.col("loose")).alias("loose"),
            F.count_if("loose").alias("rows"),
        ).first()
        if open_bins is not None and bins["all"] >= open_bins:
            return _union([*settled, before])
        if done_bins + bins["all"] <= need or n_groups == 1 or bins["loose"] < 2:
            return _union([*settled, packed])
        settled.append(packed.where(~F.col("loose")))
        before = packed.where("loose")
        done_bins += bins["all"] - bins["loose"]
        rows, n_rows, open_bins = before.select(*columns), bins["rows"], bins["loose"]
    return _union([*settled, before])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("loose", "row_id")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids are those of its text and the end id; null and empty texts are the end
    id alone. Only documents above ``capacity`` are cut. Repeated rows are packed one by
    one and null ids stay null; an empty table gives no rows, other columns are ignored.
    """
    prepare(docs.sparkSession)
    found = pin(pieces(docs, path or default_tokenizer(), capacity), "pieces")
    return pack_pieces(found, capacity)


def op9_best_fit_packing(spark, sf_dir):
    return pack_documents(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
