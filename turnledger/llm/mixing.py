"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source sends its documents in a random but repeatable order, pass after pass. The
virtual finish time of a document is the number of words its source has sent up to and
including it, divided by the source's target. Documents are taken in the order of finish
times until the total budget is used.

Running sums never gather a source: documents fall into about ``sqrt(n)`` ranges of the
shuffled order, ranges are summed, and only the rows of one range are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.frames import boxed, pin, prepare, unboxed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
SEED = 11


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _spread(docs: DataFrame) -> DataFrame:
    """Source, id, size and place in the shuffled order of each document, beside its whole row."""
    key = F.xxhash64(F.lit(SEED), F.col("row.doc_id"), F.col("row.source"), F.col("row.text"))
    place = (F.shiftrightunsigned(key, 11).cast("double")) / F.lit(float(1 << 53))
    return boxed(docs).select(
        "row",
        F.col("row.source").alias("_source"),
        F.col("row.doc_id").alias("_id"),
        n_words("row.text").alias("_size"),
        key.alias("_key"),
        place.alias("_place"),
    )


def source_targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES
) -> DataFrame:
    """One row per source: size, target, number of ranges and rank.

    Sources by code point, null last, take ``weights`` in turn and split ``share`` of all
    words. A target stops at ``passes`` times the source's size and the excess goes to the
    others by weight, until none is above: with sources ordered by cap per weight, the
    first one that an equal level no longer fills sets the level for all that follow.
    """
    sources = rows.groupBy("_source").agg(
        F.sum("_size").alias("_source_size"),
        F.count("*").alias("_source_rows"),
    )
    ranked = sources.withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("_source"))) - 1
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    every = Window.partitionBy()
    level = (
        share * F.sum("_source_size").over(every)
        - F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("_weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = (
        ranked.withColumn("_weight", weight)
        .withColumn("_cap", passes * F.col("_source_size").cast("double"))
        .withColumn("_level", level)
        .withColumn("_open", F.col("_level") * F.col("_weight") < F.col("_cap"))
    )
    first_open = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_weight"), "_rank", "_level"))).over(every)
    return levelled.withColumn("_common", first_open["_level"]).select(
        "_source",
        "_source_size",
        F.least("_cap", F.coalesce(F.col("_common") * F.col("_weight"), F.col("_cap"))).alias("_target"),
        F.greatest(F.lit(1), F.ceil(F.sqrt("_source_rows"))).alias("_ranges"),
        "_rank",
        "_source_rows",
    )


def _tagged(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's figures and the range of the shuffled order they fall in."""
    own = sources.withColumnRenamed("_source", "_named")
    return (
        rows.join(own, rows["_source"].eqNullSafe(own["_named"]))
        .drop("_named")
        .withColumn("_range", F.floor(F.col("_place") * F.col("_ranges")))
    )


def _offsets(tagged: DataFrame) -> DataFrame:
    """Words a source has sent before each range; about ``sqrt(n)`` rows a source."""
    earlier = Window.partitionBy("_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.groupBy("_rank", "_range")
        .agg(F.sum("_size").alias("_words"))
        .select("_rank", "_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    )


def _placed(tagged: DataFrame, offsets: DataFrame) -> DataFrame:
    """Words its source has sent up to and including each document, in the first pass."""
    own = Window.partitionBy("_rank", "_range").orderBy("_place", "_key", "_id", "_size")
    running = F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tagged.join(offsets, ["_rank", "_range"]).withColumn("_sent", F.col("_before") + running)


def _entry(extra: int) -> Column:
    """Sort key of a document's turn in pass ``extra``, led by its virtual finish time."""
    sent = F.col("_sent") + extra * F.col("_source_size")
    return F.struct(
        (sent / F.col("_target")).alias("finish"),
        F.col("_rank").alias("rank"),
        F.col("_key").alias("key"),
        F.lit(extra).alias("extra"),
    )


class _Cut:
    """Which turns fit the budget: all in earlier ranges, and up to ``last`` in the range that fills it."""

    def __init__(self, placed: DataFrame, budget: int, ranges: int, passes: int):
        self.ranges, self.bin, self.last = ranges, None, None
        turns = F.explode(F.array(*[_entry(p) for p in range(passes)]))
        entries = placed.where("_size > 0").select("_size", turns.alias("turn"))
        entries = entries.withColumn("bin", self._bin(F.col("turn.finish")))
        upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = (
            entries.groupBy("bin")
            .agg(F.sum("_size").alias("words"))
            .withColumn("upto", F.sum("words").over(upto))
            .where(F.col("upto") > budget)
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("first"))
            .first()["first"]
        )
        if full is None:
            return
        self.bin = full["bin"]
        running = F.sum("_size").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        self.last = (
            entries.where(F.col("bin") == self.bin)
            .withColumn("upto", running + full["before"])
            .where(F.col("upto") <= budget)
            .agg(F.max("turn").alias("last"))
            .first()["last"]
        )

    def _bin(self, finish: Column) -> Column:
        return F.floor(finish * F.lit(float(self.ranges)))

    def admits(self, turn: Column) -> Column:
        if self.bin is None:
            return F.lit(True)
        at = self._bin(turn["finish"])
        if self.last is None:
            return at < self.bin
        last = F.struct(
            F.lit(self.last["finish"]).alias("finish"),
            F.lit(self.last["rank"]).alias("rank"),
            F.lit(self.last["key"]).cast("long").alias("key"),
            F.lit(self.last["extra"]).alias("extra"),
        )
        return (at < self.bin) | ((at == self.bin) & (turn <= last))


class MixPlan:
    """Targets, offsets and cutoff of a mix: small written tables and one row."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...], share: float, passes: int):
        prepare(docs.sparkSession)
        self.passes = passes
        self.rows = pin(_spread(docs).select("_source", "_id", "_size", "_key", "_place"), "mix-rows")
        self.sources = pin(source_targets(self.rows, weights, share, passes), "mix-sources")
        totals = self.sources.agg(F.sum("_target").alias("target"), F.sum("_source_rows").alias("n")).first()
        tagged = _tagged(self.rows, self.sources)
        self.offsets = pin(_offsets(tagged), "mix-offsets")
        budget = int((totals["target"] or 0.0) + 1e-6)
        ranges = int((totals["n"] or 0) ** 0.5) + 1
        self.cut = _Cut(_placed(tagged, self.offsets), budget, ranges, passes)

    def taken(self, rows: DataFrame) -> DataFrame:
        """Rows of ``_spread`` with ``_copies``, the number of passes that take the document."""
        placed = _placed(_tagged(rows, self.sources), self.offsets)
        admitted = [F.when(self.cut.admits(_entry(p)), 1).otherwise(0) for p in range(self.passes)]
        return placed.withColumn("_copies", F.when(F.col("_size") > 0, sum(admitted, F.lit(0))).otherwise(0))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = MAX_PASSES,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``taken`` is the size times the passes that take the document whole, so a source ends
    within one document of its target. Texts without words take nothing; a null text has
    size 0 and a null source is a source. Rows repeated with id, source and text are equal
    in the order and each is taken by its own turn. Only the figures of all sources, one
    row each, are ordered in one task. An empty table gives no rows; other columns are
    ignored.
    """
    plan = MixPlan(docs, weights, share, passes)
    return plan.taken(plan.rows).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = MAX_PASSES,
) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it.

    The texts are shuffled once, into the ranges in which they are numbered.
    """
    plan = MixPlan(docs, weights, share, passes)
    taken = plan.taken(_spread(docs)).where("_copies > 0")
    return unboxed(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def op1_weighted_fair_mix(spark, sf_dir):
    return mix_sources(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))
