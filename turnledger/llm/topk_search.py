"""Exact top-k inner-product search by a three-phase uniform threshold.

Dimensions are split into blocks; a block gives every query a list of partial scores.
Phase 1 resolves the candidates that lead some list of their chunk and gathers the best
totals: the k-th of them is a cutoff no result can be below. Phase 2 broadcasts the cutoff;
a candidate matters only if some partial reaches an equal share of it. Phase 3 resolves the
totals of those exactly and keeps k a query.

Queries are taken in blocks of bounded size; each block is broadcast and compared with all
rows in one pass over the vectors.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.frames import pin, prepare, scratch_path

K = 10
SCALE = 1024.0
QUERY_EVERY = 100
QUERIES_PER_BLOCK = 1024
ROWS_PER_CHUNK = 4096
LISTS = 4

LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1
WIDEST = 10**38 - 1

SCHEMA = "query_id long, rank int, vec_id long, score long"


def whole_vector(column: str = "embedding") -> Column:
    """``floor(1024 * x)`` of each component; null unless all are present and finite."""
    x = F.col(column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(x, lambda e: F.floor(F.lit(SCALE) * e.cast("double"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; vectors shorter than ``width`` end in zeros."""
    flat, offsets = column.flatten().to_numpy(), np.asarray(column.offsets)
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    for i, n in enumerate(lengths):
        out[i, :n] = flat[offsets[i] - offsets[0] : offsets[i] - offsets[0] + n]
    return out


def chunks(batches, width: int):
    """``row_id, vec_id, vectors`` of a partition, a bounded number of rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_PER_CHUNK:
            yield _joined(held, width)
            held, n = [], 0
    if n:
        yield _joined(held, width)


def _joined(batches: list[pa.RecordBatch], width: int):
    table = pa.Table.from_batches(batches).combine_chunks()
    return table["row_id"].to_numpy(), table["vec_id"].combine_chunks(), matrix(table["v"].combine_chunks(), width)


def partial_scores(x: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Exact partial scores, one list per block of dimensions."""
    width = x.shape[1]
    top = max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1.0) * max(
        float(np.abs(queries.astype(np.float64)).max(initial=0)), 1.0
    )
    kind = np.float64 if top * max(width, 1) < 2**53 else object
    cuts = np.linspace(0, width, min(LISTS, max(width, 1)) + 1).astype(int)
    return [
        x[:, a:b].astype(kind) @ queries[:, a:b].astype(kind).T for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def leading_totals(parts: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: for each query the best totals among candidates that lead some list.

    ``own`` marks a query's own row. Returns query numbers and totals, at most k a query.
    """
    n = parts[0].shape[0]
    lead = min(k + 1, n)
    heads = [np.argpartition(-p, lead - 1, axis=0)[:lead] if lead < n else _all(p) for p in parts]
    index = np.sort(np.concatenate(heads), axis=0)
    fresh = np.ones(index.shape, dtype=bool)
    fresh[1:] = index[1:] != index[:-1]
    column = np.broadcast_to(np.arange(index.shape[1]), index.shape)
    fresh &= ~own[index, column]
    at, query = index[fresh], column[fresh]
    score = sum(p[at, query] for p in parts)
    order = np.lexsort((-score, query))
    query, score = query[order], score[order]
    within = np.arange(len(query)) - np.searchsorted(query, query)
    return query[within < k], score[within < k]


def _all(part: np.ndarray) -> np.ndarray:
    return np.broadcast_to(np.arange(part.shape[0])[:, None], part.shape)


def sufficient(
    parts: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray, known: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: rows with a partial of at least an equal share of the cutoff, resolved.

    ``cutoff`` holds whole numbers; queries not ``known`` have none. The share is rounded down.
    """
    kind = parts[0].dtype
    share = (cutoff // len(parts)).astype(kind)
    reached = np.broadcast_to(~known, own.shape).copy()
    for part in parts:
        reached |= (part >= share).astype(bool)
    row, query = np.nonzero(reached & ~own)
    score = sum(p[row, query] for p in parts)
    good = ~known[query] | (score >= cutoff[query].astype(kind)).astype(bool)
    return row[good], query[good], score[good]


def as_long(score: np.ndarray) -> pa.Array:
    if score.dtype == object:
        score = np.array([min(max(int(s), LEAST_LONG), MOST_LONG) for s in score], dtype=np.int64)
    return pa.array(score.astype(np.int64))


def as_whole(score: np.ndarray) -> pa.Array:
    """Scores as decimals, so that those beyond a long still rank."""
    if score.dtype == object:
        return pa.array([Decimal(min(max(int(s), -WIDEST), WIDEST)) for s in score], pa.decimal128(38, 0))
    return pa.array(score.astype(np.int64)).cast(pa.decimal128(38, 0))


def _search_block(rows: DataFrame, block: pa.Table, width: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    query_rows = block["row_id"].to_numpy()
    queries = matrix(block["v"].combine_chunks(), width)
    shared = spark.sparkContext.broadcast((query_rows, queries))

    def gather(batches):
        own_rows, own_vectors = shared.value
        for row_id, _, x in chunks(batches, width):
            query, score = leading_totals(
                partial_scores(x, own_vectors), row_id[:, None] == own_rows[None, :], k
            )
            yield pa.RecordBatch.from_arrays([pa.array(query), as_long(score)], names=["query", "score"])

    best = Window.partitionBy("query").orderBy(F.desc("score"))
    safe = (
        rows.mapInArrow(gather, "query long, score long")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
        .groupBy("query")
        .agg(F.count("*").alias("n"), F.min("score").alias("cutoff"))
        .where(F.col("n") == k)
        .toArrow()
    )
    cutoff = np.full(len(query_rows), LEAST_LONG, dtype=np.int64)
    cutoff[safe["query"].to_numpy()] = safe["cutoff"].to_numpy()
    # The least long may stand for anything below it, so it cuts nothing off.
    sent = spark.sparkContext.broadcast((cutoff, cutoff > LEAST_LONG))

    def resolve(batches):
        own_rows, own_vectors = shared.value
        for row_id, vec_id, x in chunks(batches, width):
            row, query, score = sufficient(
                partial_scores(x, own_vectors), row_id[:, None] == own_rows[None, :], *sent.value
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(row_id[row]), vec_id.take(pa.array(row)), as_whole(score)],
                names=["query", "row_id", "vec_id", "score"],
            )

    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_id")
    names = spark.createDataFrame(
        pa.table({"query": np.arange(len(query_rows)), "query_id": block["vec_id"]})
    )
    return (
        rows.mapInArrow(resolve, "query long, row_id long, vec_id long, score decimal(38,0)")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .join(F.broadcast(names), "query")
        .withColumn("score", F.least(F.greatest("score", F.lit(LEAST_LONG)), F.lit(MOST_LONG)).cast("long"))
        .select("query_id", "rank", "vec_id", "score")
    )


def search(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """The k best rows of every query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all other
    rows, repeated ids included, with ties to the smaller id, null last. Vectors that are
    null or hold a null, NaN or infinity take no part; shorter vectors count as ending in
    zeros. Scores beyond a long rank by their
    exact value, up to 38 digits, and are returned as its bounds. Rows with a null id are candidates only.
    An empty table or one without queries gives no rows; other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_vector().alias("v"))
    rows = pin(
        rows.where(F.col("v").isNotNull()).withColumn("row_id", F.monotonically_increasing_id()), "search-rows"
    )
    queries = rows.where(F.col("vec_id") % query_every == 0)
    n_queries = queries.count()
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    n_blocks = -(-n_queries // QUERIES_PER_BLOCK)
    if not n_blocks or not width:
        return spark.createDataFrame([], SCHEMA)
    path = scratch_path(spark, "search-results")
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(n_blocks)))
    for number in range(n_blocks):
        block = numbered.where(F.col("block") == number).select("row_id", "vec_id", "v").toArrow()
        if block.num_rows:
            _search_block(rows, block, width, k).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def op7_topk_search(spark, sf_dir):
    return search(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
         vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
