"""Exact duplicates by progressive refinement.

Rows are grouped by the length of their normalised text, rows of lengths that occur more
than once by a hash of its beginning, and only rows that still share both by a hash of
the full content. Every step works on one thin row per document and counts map-side before
it shuffles, so a hot length or group arrives as one row per task; no group is gathered and
no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.frames import SPACES, boxed, pin, prepare, unboxed

PREFIX_CHARS = 64


def normalised(text: str | Column = "text") -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def full_hash(text: str | Column = "text") -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _features(docs: DataFrame) -> DataFrame:
    """One thin row per document; ``n_points`` are the code points of the original text."""
    return docs.select(
        "doc_id",
        "text",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        normalised().alias("normal"),
    ).select(
        "doc_id",
        "text",
        "n_points",
        F.length("normal").cast("long").alias("n_normal"),
        F.xxhash64(F.substring("normal", 1, PREFIX_CHARS)).alias("prefix_hash"),
    )


def refine(docs: DataFrame, digest_all: bool) -> DataFrame:
    """Thin rows ``doc_id, n_points, n_normal, prefix_hash, text_sha256``.

    With ``digest_all`` every text is hashed in the scan that measures it, because the
    caller returns the hash of each row. Without it the hash is null for rows whose length
    or prefix is unique: the texts are read again, and only surviving groups are hashed.
    """
    prepare(docs.sparkSession)
    thin = ["doc_id", "n_points", "n_normal", "prefix_hash"]
    if digest_all:
        return pin(
            docs.transform(_features).select(*thin, full_hash().alias("text_sha256")), "dedup-features"
        )
    features = pin(docs.transform(_features).select(*thin), "dedup-features")
    survivors = pin(_survivors(features), "dedup-survivors")
    keys = ["n_normal", "prefix_hash"]
    rest = features.join(survivors, keys, "left_anti").select(*thin, F.lit(None).cast("string").alias("text_sha256"))
    hashed = (
        docs.transform(_features)
        .join(survivors, keys, "left_semi")
        .select(*thin, full_hash().alias("text_sha256"))
    )
    return rest.unionByName(hashed)


def _survivors(features: DataFrame) -> DataFrame:
    """Pairs of length and prefix hash that more than one row has, among repeated lengths."""
    counted = features.groupBy("n_normal", "prefix_hash").agg(F.count("*").alias("n"))
    lengths = counted.groupBy("n_normal").agg(F.sum("n").alias("n")).where("n > 1")
    return counted.where("n > 1").join(lengths, "n_normal", "left_semi").drop("n")


def exact_dedup(docs: DataFrame, digest_all: bool = True) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, n_points``.

    Texts are equal when identical after white space is deleted. Of equal texts the row
    with the most code points stays, then the smallest id, null last. Null texts count as
    empty, and all empty texts are equal. Of rows repeated with id and length exactly one
    is kept. An empty table gives no rows; other columns are ignored.
    """
    rows = refine(docs, digest_all)
    survivors = _survivors(rows)
    same = (
        rows.groupBy("n_normal", "prefix_hash", "text_sha256")
        .agg(
            F.count("*").alias("group_size"),
            F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id")).alias("first"),
        )
        .where("group_size > 1 AND text_sha256 IS NOT NULL")
        .join(survivors, ["n_normal", "prefix_hash"], "left_semi")
        .select(
            "text_sha256",
            "group_size",
            F.col("first.doc_id").alias("keep_id"),
            (-F.col("first.col1")).alias("keep_points"),
        )
    )
    # Rows that agree in id, length and content are counted, so that one of them can stay.
    counted = rows.groupBy("doc_id", "n_points", "n_normal", "prefix_hash", "text_sha256").agg(
        F.count("*").alias("copies")
    )
    joined = counted.join(same, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("stays"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        "text_sha256",
        "n_points",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        "n_points",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts."""
    found = exact_dedup(docs, digest_all=True)
    # Ids, hashes and lengths of what goes, and of rows repeated of which one stays.
    verdict = (
        found.groupBy("doc_id", "text_sha256", "n_points")
        .agg(F.count_if("kept").alias("stay"), F.count("*").alias("copies"))
        .where("copies > stay")
    )
    tagged = boxed(docs).select(
        "row",
        F.col("row.doc_id").alias("own_id"),
        full_hash(F.col("row.text")).alias("own_hash"),
        F.length(F.coalesce("row.text", F.lit(""))).cast("long").alias("own_points"),
    )
    joined = tagged.join(
        verdict,
        tagged["own_id"].eqNullSafe(verdict["doc_id"])
        & (tagged["own_hash"] == verdict["text_sha256"])
        & (tagged["own_points"] == verdict["n_points"]),
        "left",
    )
    whole = joined.where(F.col("copies").isNull()).select("row")
    twins = joined.where("stay > 0").dropDuplicates(["own_id", "own_hash", "own_points"]).select("row")
    return unboxed(whole.unionByName(twins))


def op5_exact_dedup(spark, sf_dir):
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("n_points")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
