"""Near duplicates: Jaccard join of word shingles through a MinHash LSH forest.

Texts with the same words are one node. Each of ``TREES`` prefix tries orders the nodes by
a sequence of MinHash values. Matching starts at the full depth and shortens the prefix
until two sets at the similarity threshold share one in some trie with the target recall.
Within a trie node the children's centres are compared with its own centre, so a trie of m
members gives m - 1 pairs, not m squared. Pairs are verified exactly.

What a centre leaves apart is resolved exactly as well: where members of one shortest
prefix still lie in different components, those outside the largest are compared with all
members of other components, in blocks of bounded size that emit verified links only.
Classes therefore equal those of comparing all pairs that share a shortest prefix.

Links are counted, not listed: within a class all texts are compared with all, in blocks of
bounded size that return one partial count per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.components import components
from turnledger.llm.frames import boxed, identity, pin, prepare, text_bytes, unboxed
from turnledger.llm.text import (
    WHITESPACE,
    Slice,
    as_long,
    byte_codes,
    mix,
    per_document,
    runs,
    slices,
    words,
)

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 6
TARGET_RECALL = 0.9995
#: Shingles of the members and of the residual rows in one block of the residual comparison.
MEMBER_SHINGLES = 1 << 19
RESIDUAL_SHINGLES = 1 << 16

_CODES = byte_codes(fold_case=False)
_RNG = np.random.default_rng(4)
_FACTORS = (_RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shortest_prefix(similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> int:
    """Shorten from the full depth until the recall at the threshold reaches the target."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < recall:
        depth -= 1
    return depth


PREFIXES = list(range(shortest_prefix(), DEPTH + 1))
KEYS = [f"k{d}" for d in PREFIXES]


def shingles(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, their bounds, and a 128-bit digest of each document's words."""
    found = words(part, WHITESPACE, _CODES)
    place = (np.arange(len(found.hashes)) - np.repeat(found.bounds[:-1], found.counts)).astype(np.uint64)
    halves = [
        per_document(mix(found.hashes ^ mix((place + np.uint64(k)) * _GOLDEN)), found.bounds, np.add, 0)
        for k in (1, 1 << 40)
    ]
    hashes, bounds = runs(found, SHINGLE_WORDS)
    return hashes, bounds, np.stack(halves, axis=1)


def prefix_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of the prefixes of each document, shortest first: ``(documents, trees, prefixes)``."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(bounds) - 1, TREES, len(PREFIXES)), dtype=np.uint64)
    for tree in range(TREES):
        key = np.full(len(bounds) - 1, tree + 1, dtype=np.uint64)
        for level in range(DEPTH):
            j = tree * DEPTH + level
            least = per_document(short * _FACTORS[j] + _SHIFTS[j], bounds, np.minimum, 0)
            key = mix(key * _GOLDEN + least.astype(np.uint64) + np.uint64(1))
            if level + 1 in PREFIXES:
                out[:, tree, PREFIXES.index(level + 1)] = key
    return out


def _digests(halves: np.ndarray) -> pa.Array:
    raw = halves.astype(">u8").tobytes()
    offsets = np.arange(0, len(raw) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(halves), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(as_long(flat)))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, node, keys`` of every document; node and keys are null without words."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, node binary, keys array<long>"

    def sign(batches):
        for batch in batches:
            for part in slices(batch.column("body")):
                hashes, bounds, halves = shingles(part)
                keys = prefix_keys(hashes, bounds)
                size = TREES * len(PREFIXES)
                rows = batch.slice(part.first, part.last - part.first)
                empty = pa.array(np.diff(bounds) == 0)
                node, lists = _digests(halves), _lists(keys.reshape(-1), np.arange(len(keys) + 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("text_key"),
                        pa.compute.if_else(empty, pa.scalar(None, node.type), node),
                        pa.compute.if_else(empty, pa.scalar(None, lists.type), lists),
                    ],
                    names=["doc_id", "text_key", "node", "keys"],
                )

    return docs.select(*identity(docs), text_bytes().alias("body")).mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``node, n, own, first_keys`` of the documents in ``needed``: sorted distinct shingles and
    the shortest prefix in every trie. Their texts are read again; all others are passed over."""

    def collect(batches):
        for batch in batches:
            for part in slices(batch.column("body")):
                hashes, bounds, halves = shingles(part)
                first = prefix_keys(hashes, bounds)[:, :, 0]
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                size = np.array([len(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        _digests(halves),
                        pa.array(size),
                        _lists(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.append(0, np.cumsum(size))),
                        _lists(first.reshape(-1), np.arange(len(first) + 1) * TREES),
                    ],
                    names=["node", "n", "own", "first_keys"],
                )

    own = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"), text_bytes().alias("body"))
    wanted = needed.select("doc_id", "text_key")
    return (
        own.join(
            wanted, (own["own_key"] == wanted["text_key"]) & own["own_id"].eqNullSafe(wanted["doc_id"]), "left_semi"
        )
        .select("body")
        .mapInArrow(collect, "node binary, n long, own array<long>, first_keys array<long>")
        .dropDuplicates(["node"])
    )


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """``node, tree`` and prefix keys wherever another node shares the shortest prefix."""
    per_tree = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(
            t.alias("tree"),
            *[F.element_at("keys", t * len(PREFIXES) + i + 1).alias(k) for i, k in enumerate(KEYS)],
        ),
    )
    placed = nodes.select("node", F.explode(per_tree).alias("at")).select("node", "at.*")
    shared = placed.groupBy(KEYS[0]).agg(F.count("*").alias("members")).where("members > 1").select(KEYS[0])
    return placed.join(shared, KEYS[0], "left_semi")


def trie_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of a trie node's centre and the centres of its children."""
    rows, found = members.select("node", *KEYS), None
    for key in reversed(KEYS):
        centres = (
            rows.groupBy(key)
            .agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("node", key), "node")).alias("centre"))
            .where("members > 1")
            .select(key, F.col("centre.node").alias("centre"))
        )
        joined = rows.join(centres, key, "left")
        pairs = joined.where(F.col("centre") != F.col("node")).select(
            F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
        )
        found = pairs if found is None else found.union(pairs)
        rows = joined.where(F.col("centre").isNull() | (F.col("centre") == F.col("node"))).select("node", *KEYS)
    return found.distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose shingle sets reach the similarity, counted exactly."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("own_a") + F.size("own_b")).alias("total"))
        .where(F.col("both") / (F.col("total") - F.col("both")) >= SIMILARITY)
        .select("a", "b")
    )


def _first_links(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """For each residual node, a verified link into every other component of the block."""
    found_a, found_b = [], []
    if left.num_rows and right.num_rows:
        tree = left["tree"][0].as_py()
        keys_b = right["first_keys"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        keys_a = left["first_keys"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        own_b = right["own"].combine_chunks()
        flat, n_b = own_b.flatten().to_numpy().view(np.uint64), right["n"].to_numpy()
        opens = np.cumsum(n_b) - n_b
        labels = {x: i for i, x in enumerate(set(right["label"].to_pylist()) | set(left["label"].to_pylist()))}
        label_b = np.array([labels[x] for x in right["label"].to_pylist()])
        names_b = right["node"].to_pylist()
        rows = zip(left["node"].to_pylist(), left["label"].to_pylist(), left["own"].to_pylist(), keys_a, strict=True)
        for node, label, own, own_keys in rows:
            mine = np.array(own, dtype=np.int64).view(np.uint64)
            n_a = len(mine)
            fits = (label_b != labels[label]) & (n_b >= SIMILARITY * n_a) & (n_a >= SIMILARITY * n_b)
            at = np.flatnonzero(fits)
            # A pair that shares several tries is compared in the first of them only.
            at = at[(keys_b[at] == own_keys).argmax(axis=1) == tree]
            if not len(at):
                continue
            size = n_b[at]
            start = np.cumsum(size) - size
            values = flat[np.repeat(opens[at] - start, size) + np.arange(size.sum())]
            near = np.minimum(np.searchsorted(mine, values), n_a - 1)
            both = np.add.reduceat((mine[near] == values).astype(np.int64), start)
            linked = at[both / (n_a + size - both) >= SIMILARITY]
            for i in linked[np.unique(label_b[linked], return_index=True)[1]]:
                found_a.append(min(node, names_b[i]))
                found_b.append(max(node, names_b[i]))
    return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})


def _dealt(
    rows: DataFrame, sets: DataFrame, own_block: str, other_block: str, blocks: list[str], held: list[str]
) -> DataFrame:
    """``rows`` with their sets, each in one block of its own side and in all of the other's."""
    body = sets.select(F.col("node").alias("found"), "own", "first_keys")
    return (
        rows.withColumn(own_block, F.pmod(F.xxhash64(F.lit(own_block), "node"), F.col(f"{own_block}s")).cast("int"))
        .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(f"{other_block}s") - 1)))
        .join(body, F.col("node") == body["found"])
        # New column references, as both sides of the cogroup come from the same rows.
        .select(*[F.col(c).alias(c) for c in (*blocks, "node", *held)])
    )


def residual_links(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components that share a shortest prefix but that no centre has joined."""
    first = KEYS[0]
    own = labels.withColumnRenamed("node", "named")
    sizes = sets.select(F.col("node").alias("sized"), "n")
    rows = (
        members.select("node", "tree", first)
        .join(own, F.col("node") == own["named"], "left")
        .join(sizes, F.col("node") == sizes["sized"])
        .select("node", "tree", first, F.coalesce("label", "node").alias("label"), "n")
    )
    by_label = rows.groupBy(first, "label").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    open_buckets = (
        by_label.groupBy(first)
        .agg(
            F.sum("members").alias("members"),
            F.count("*").alias("labels"),
            F.sum("shingles").alias("shingles"),
            F.max(F.struct("shingles", "label")).alias("main"),
        )
        # Two members have been compared already.
        .where("labels > 1 AND members > 2")
        .select(
            first,
            F.col("main.label").alias("main"),
            F.ceil(F.col("shingles") / MEMBER_SHINGLES).cast("int").alias("member_blocks"),
            F.ceil((F.col("shingles") - F.col("main.shingles")) / RESIDUAL_SHINGLES).cast("int").alias("residual_blocks"),
        )
    )
    rows = pin(rows.join(open_buckets, first), "residual-rows")
    blocks, held = ["tree", first, "residual_block", "member_block"], ["label", "n", "own", "first_keys"]
    left = _dealt(rows.where(F.col("label") != F.col("main")), sets, "residual_block", "member_block", blocks, held)
    right = _dealt(rows, sets, "member_block", "residual_block", blocks, held)
    return (
        left.groupBy(*blocks)
        .cogroup(right.groupBy(*blocks))
        .applyInArrow(_first_links, "a binary, b binary")
        .distinct()
    )


def _count_links(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """For each left node, how many texts of other nodes of the right block are similar enough."""
    counts = np.zeros(left.num_rows, dtype=np.int64)
    if left.num_rows and right.num_rows:
        n_a, n_b = left["n"].to_numpy(), right["n"].to_numpy()
        flat = right["own"].combine_chunks().flatten().to_numpy()
        mine = left["own"].combine_chunks().flatten().to_numpy()
        shingle, place = np.unique(flat, return_inverse=True)
        near = np.minimum(np.searchsorted(shingle, mine), len(shingle) - 1)
        there = shingle[near] == mine
        opens_a, opens_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        copies = right["copies"].to_numpy()
        own_copies = dict(zip(right["node"].to_pylist(), copies.tolist(), strict=True))
        marked = np.zeros(len(shingle), dtype=np.int64)
        for i, node in enumerate(left["node"].to_pylist()):
            span = slice(opens_a[i], opens_a[i] + n_a[i])
            held = near[span][there[span]]
            marked[held] = 1
            both = np.add.reduceat(marked[place], opens_b)
            marked[held] = 0
            similar = both / (n_a[i] + n_b - both) >= SIMILARITY
            counts[i] = copies[similar].sum() - own_copies.get(node, 0)
    return pa.table({"node": left["node"], "n_links": counts})


def link_counts(labels: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    """``node, n_links`` of every labelled node: the texts of other nodes of its class that are similar.

    ``copies`` tells how many texts a ``node`` stands for.
    """
    sizes = sets.select(F.col("node").alias("sized"), "n")
    held = copies.select(F.col("node").alias("held"), "copies")
    rows = (
        labels.join(sizes, F.col("node") == sizes["sized"])
        .join(held, F.col("node") == held["held"])
        .select("node", "label", "n", "copies")
    )
    classes = (
        rows.groupBy("label")
        .agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.sum("copies").alias("texts"))
        .select(
            F.col("label").alias("class"),
            "members",
            "texts",
            F.ceil(F.col("shingles") / MEMBER_SHINGLES).cast("int").alias("member_blocks"),
            F.ceil(F.col("shingles") / RESIDUAL_SHINGLES).cast("int").alias("residual_blocks"),
        )
    )
    rows = pin(rows.join(classes, F.col("label") == F.col("class")).drop("class"), "link-rows")
    blocks, open_rows = ["label", "residual_block", "member_block"], rows.where("members > 2")
    left = _dealt(open_rows, sets, "residual_block", "member_block", blocks, ["n", "copies", "own"])
    right = _dealt(open_rows, sets, "member_block", "residual_block", blocks, ["n", "copies", "own"])
    counted = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(_count_links, "node binary, n_links long")
    # Two nodes in a class are linked to each other.
    pairs = rows.where("members = 2").select("node", (F.col("texts") - F.col("copies")).alias("n_links"))
    return pairs.union(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signed rows, per node its class ``node, class_row, class_size``, labels of linked nodes, and sets."""
    prepare(docs.sparkSession)
    signed = pin(signatures(docs), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(row).alias("row"), F.count("*").alias("copies"), F.first("keys").alias("keys")
    )
    members = pin(shared_prefixes(nodes), "trie-members")
    listed = members.select("node").distinct()
    needed = nodes.join(listed, "node", "left_semi").select("row.doc_id", "row.text_key")
    sets = pin(shingle_sets(docs, needed), "shingle-sets")
    links = pin(verified(trie_pairs(members), sets), "links")
    labels = components(links)
    further = pin(residual_links(members, sets, labels), "links-residual")
    if further.take(1):
        links = links.union(further).distinct()
        labels = components(links)
    own = labels.withColumnRenamed("node", "named")
    labelled = (
        nodes.select("node", "row", "copies")
        .join(own, F.col("node") == own["named"], "left")
        .select("node", "row", "copies", F.coalesce("label", "node").alias("label"))
    )
    classes = labelled.groupBy("label").agg(F.min("row").alias("class_row"), F.sum("copies").alias("class_size"))
    per_node = (
        labelled.select("node", "label", "copies")
        .join(classes, "label")
        .select("node", "class_row", "class_size", "copies")
    )
    return signed, per_node, labels, sets


def ngram_jaccard(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, n_links``.

    Words are runs of ``[^\\x20\\x09-\\x0D]``; a text of fewer than five words is one shingle.
    Documents are in one class if a chain of pairs with Jaccard similarity of 0.8 or more
    joins them; ``class_id`` is the smallest id in it, null last. ``n_links`` counts all
    other documents of the class with that similarity, those of the same words included. Null texts and texts without words are
    alone. Repeated rows are copies; an empty table gives no rows; other columns are ignored.
    """
    signed, per_node, labels, sets = _classes(docs)
    degree = link_counts(labels, sets, per_node).withColumnRenamed("node", "linked")
    named = per_node.join(degree, F.col("node") == degree["linked"], "left").select(
        F.col("node").alias("named"), "class_row", "class_size",
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return signed.join(named, signed["node"] == named["named"], "left").select(
        signed["doc_id"],
        F.when(F.col("named").isNull(), signed["doc_id"]).otherwise(F.col("class_row.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each class; texts without words stay."""
    signed, per_node, _, _ = _classes(docs)
    named = per_node.where("class_size > 1").withColumnRenamed("node", "named")
    verdict = (
        signed.join(named, signed["node"] == named["named"])
        .groupBy(signed["doc_id"].alias("at_id"), signed["text_key"].alias("at_key"))
        .agg(
            F.count("*").alias("copies"),
            F.max(
                F.col("doc_id").eqNullSafe(F.col("class_row.doc_id"))
                & (F.col("text_key") == F.col("class_row.text_key"))
            ).alias("first"),
        )
        .where("NOT first OR copies > 1")
    )
    tagged = boxed(docs).select(
        "row", F.col("row.doc_id").alias("own_id"), F.xxhash64("row.text").alias("own_key")
    )
    joined = tagged.join(
        verdict, (F.col("own_key") == F.col("at_key")) & F.col("own_id").eqNullSafe(F.col("at_id")), "left"
    )
    whole = joined.where(F.col("copies").isNull()).select("row")
    firsts = joined.where("first").dropDuplicates(["own_id", "own_key"]).select("row")
    return unboxed(whole.unionByName(firsts))


def op4_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
