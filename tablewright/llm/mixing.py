"""Mix sources to target weights with a low-discrepancy schedule.

Points of the golden-ratio sequence pass through the cumulative weights, so every stretch of the
schedule holds the sources in proportion. The r-th slot of a source takes the r-th block of its
stream: its documents in a shuffled order, cut into blocks of equally many tokens, repeated from
the start when the source is used more than once.

A source may hold most of the rows: its order is made from the leading digits of a hash, summed per
bucket, and only rows of one bucket are sorted together. Tables with a row per source are the only
ones that are ordered as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.common import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # tokens of the mix, as a part of all tokens
EPOCHS = 2  # how often a source is used at most
SLOTS = 1 << 20  # of the schedule, about; the block length follows from it
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets a source
SEGMENT = 1 << 15  # slots that are ranked together
GOLDEN = 2654435769  # 2^32 divided by the golden ratio
CELL_BITS = 22  # of 32: 1024 cells find the source of a point
SEED = "mix"


@dataclass(frozen=True)
class Mix:
    """``documents``: ``_id, size, source_size, target, _rank, _start`` for every row;
    ``pieces``: ``slot, _rank, block, _start, _id, first_word, n_words``, in the order of ``slot``.
    """

    documents: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """The documents with ``taken``, the words that the mix takes of each, and the first and the
        last slot of the schedule that they go to (NULL where nothing is taken)."""
        words = self.pieces.groupBy("_rank", "_start").agg(
            F.sum("n_words").alias("_taken"),
            F.min("slot").alias("first_slot"),
            F.max("slot").alias("last_slot"),
        )
        return self.documents.join(words, ["_rank", "_start"], "left").withColumn(
            "taken", F.coalesce("_taken", F.lit(0)).cast("bigint")
        )


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """What each source gives: ``_rank, _source, source_size, target, _goal``.

    ``sizes`` has ``_source, source_size``. Sources in code point order, NULL last, weigh
    ``weights`` in turn. Targets stop at ``epochs`` times the source; sorted by the level at which
    they stop, the ones that stop come first, and the rest share what is left by weight.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn(
        "_weight", F.get(F.array(*map(F.lit, weights)), F.pmod("_rank", F.lit(len(weights))))
    ).withColumn("_cap", F.col("source_size") * epochs)
    level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    stops = F.col("_cap") * F.sum("_weight").over(after) <= F.col("_weight") * left
    ranked = ranked.withColumn("_stops", stops)
    capped = F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("_weight"))).over(everything)
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(
        F.col("_weight") * ((total - capped) / open_weight)
    )
    return ranked.select("_rank", "_source", "source_size", target.alias("target")).withColumn(
        "_goal", F.floor(F.col("target") + 0.5).cast("bigint")
    )


def schedule(sources: DataFrame, n_slots: int, block: int) -> DataFrame:
    """``slot, _rank, block``: slots in order, each with the source it goes to and which block.

    The goal of a source is met to the token: slots beyond it are left out, and a source that the
    points have left short by a few blocks gets them at the end.
    """
    spark = sources.sparkSession
    running = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.coalesce(F.sum("_goal").over(running), F.lit(0))
    whole = F.sum("_goal").over(everything)
    unit = F.lit(float(1 << 32))
    spans = sources.where("_goal > 0").select(
        "_rank",
        "_goal",
        F.floor(low / whole * unit).alias("_low"),
        F.floor((low + F.col("_goal")) / whole * unit).alias("_high"),
    )
    cells = spans.where("_high > _low").withColumn(
        "_cell",
        F.explode(
            F.sequence(
                F.shiftright("_low", CELL_BITS), F.shiftright(F.col("_high") - 1, CELL_BITS)
            )
        ),
    )
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(1 << 32)).alias("_point")
    )
    drawn = (
        points.withColumn("_cell", F.shiftright("_point", CELL_BITS))
        .join(cells, "_cell")
        .where("_point >= _low AND _point < _high")
        .select("slot", "_rank", (F.col("slot") / SEGMENT).cast("bigint").alias("_segment"))
    )
    counts = drawn.groupBy("_rank", "_segment").agg(F.count(F.lit(1)).alias("_slots"))
    earlier = Window.partitionBy("_rank").orderBy("_segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = counts.select(
        "_rank", "_segment", F.coalesce(F.sum("_slots").over(earlier), F.lit(0)).alias("_carry")
    )
    local = F.row_number().over(Window.partitionBy("_rank", "_segment").orderBy("slot"))
    ranked = drawn.withColumn("_local", local - 1).join(carry, ["_rank", "_segment"])
    n_blocks = F.ceil(F.col("_goal") / block)
    ranked = (
        ranked.select("slot", "_rank", (F.col("_local") + F.col("_carry")).alias("block"))
        .join(spans.select("_rank", n_blocks.alias("_blocks")), "_rank")
        .where("block < _blocks")
        .select("slot", "_rank", "block")
    )
    have = counts.groupBy("_rank").agg(F.sum("_slots").alias("_have"))
    closing = (
        spans.select("_rank", n_blocks.alias("_blocks"))
        .join(have, "_rank", "left")
        .withColumn("_have", F.coalesce("_have", F.lit(0)))
        .where("_blocks > _have")
        .select("_rank", F.explode(F.expr("sequence(_have, _blocks - 1)")).alias("block"))
        .select(
            (F.lit(n_slots) + F.col("block") * (1 << 20) + F.col("_rank")).alias("slot"),
            "_rank",
            "block",
        )
    )
    return ranked.unionAll(closing)


def mix(
    documents: DataFrame,
    size,
    weights=WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    slots: int = SLOTS,
    seed: str = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> Mix:
    """Mix ``documents`` to ``share`` of all their tokens, ``size`` giving the tokens of a row.

    Reruns agree: the order of a source is an MD5 of the seed and the id, ties broken by id and
    size (rows equal in both cannot be told apart). NULL sources are one source, the last. Rows
    without tokens are never taken; an empty table gives an empty mix. Other columns are not read.
    """
    rows = stage(
        documents.select(
            F.col(id_column).alias("_id"),
            # One key without NULL: a source "x" is "=x", no source is "".
            F.coalesce(F.concat(F.lit("="), F.col(source_column)), F.lit("")).alias("_key"),
            size.alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col(id_column).cast("string"))).alias("_order"),
        ),
        "mix-sizes",
    ).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_tokens"))
    name = F.when(F.col("_key") != "", F.expr("substring(_key, 2)"))
    sizes = buckets.groupBy("_key").agg(F.sum("_tokens").alias("source_size"))
    sources = stage(
        targets(sizes.select(name.alias("_source"), "source_size"), weights, share, epochs),
        "mix-sources",
    )
    tokens = sources.agg(F.sum("_goal")).first()[0] or 0
    block = max(1, -(-tokens // slots))
    planned = schedule(sources, -(-tokens // block), block)

    key = F.coalesce(F.concat(F.lit("="), "_source"), F.lit(""))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    prefix = buckets.join(sources.withColumn("_key", key), "_key").select(
        "_key",
        "_bucket",
        "_rank",
        "source_size",
        "target",
        "_goal",
        F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy("_key", "_bucket").orderBy("_order", "_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = stage(
        rows.withColumn("_end", F.sum("size").over(within))
        .join(prefix, ["_key", "_bucket"])
        .select(
            "_id",
            "size",
            "source_size",
            "target",
            "_rank",
            "_goal",
            F.when(
                F.col("size") > 0, F.col("_before") + F.col("_end") - F.col("size")
            ).alias("_start"),
        ),
        "mix-places",
    )
    epochs_used = placed.where("size > 0 AND _start < _goal").withColumn(
        "_epoch", F.explode(F.expr("sequence(0L, (_goal - 1 - _start) div source_size)"))
    )
    spans = epochs_used.withColumn("_from", F.expr("_epoch * source_size + _start")).withColumn(
        "_to", F.expr("least(_from + size, _goal)")
    )
    cut = spans.withColumn(
        "block", F.explode(F.expr(f"sequence(_from div {block}L, (_to - 1) div {block}L)"))
    )
    first = F.greatest("_from", F.col("block") * block)
    last = F.least("_to", (F.col("block") + 1) * block)
    pieces = cut.select(
        "_rank",
        "block",
        "_start",
        "_id",
        (first - F.col("_from")).alias("first_word"),
        (last - first).alias("n_words"),
    ).join(planned, ["_rank", "block"])
    return Mix(placed.drop("_goal"), pieces)
