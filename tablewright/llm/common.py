"""What several operators share: words, lower case, staged tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.sources.folders import fresh_folder

#: White space of all contracts: the blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "\\x20\\x09-\\x0D"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, every other character as it is (``lower`` changes all letters)."""
    return F.translate(text, UPPER, LOWER)


def trimmed(line: Column) -> Column:
    """A line without white space at its ends; most lines have none and are not looked through."""
    dense = (F.ascii(line) > 32) & (F.ascii(F.substring(line, -1, 1)) > 32)
    return F.when(dense, line).otherwise(F.btrim(line, F.lit(SPACE)))


def one_line(text: Column) -> Column:
    """The words of a text (NULL: none) with one blank after each."""
    return F.ltrim(
        F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), f"[{SPACE_CLASS}]+", " ")
    )


def n_words(text: Column) -> Column:
    """How many words a text has (NULL: 0): the blanks of :func:`one_line`."""
    line = one_line(text)
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))).cast("bigint")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    It cuts the lineage without a copy that only one executor holds: a lost executor costs the
    tasks that ran there and nothing else.
    """
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_and_free(df: DataFrame, label: str) -> DataFrame:
    """:func:`stage`, and the shuffle files behind ``df`` are deleted when it is written, not at some
    later garbage collection of the driver. For frames that are read this once."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return stage(df, label)
    finally:
        conf.set(FREE_SHUFFLES, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has a column of that name."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").where("v != least").select(
        F.col("v").alias("u"), F.col("least").alias("v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v != least").select(
        F.col("v").alias("u"), F.col("least").alias("v")
    )
    return moved.unionAll(least.select("u", F.col("least").alias("v")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of pairs ``(u, v)`` of long numbers: ``node, component``.

    ``component`` is the smallest node that can be reached. Nodes without an edge to another node
    have no row. Alternating large and small stars: each round is two joins whose state is staged,
    rounds grow with the logarithm of the longest path, and no group of nodes meets in one task (a
    minimum is aggregated on the map side, the join to it may be split where a node is hot).
    """
    edges = edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    edges = stage(edges, label)
    before = None
    while (now := _state(edges)) != before:
        if now[0] == 0:
            break
        before = now
        edges = stage(_small_star(_large_star(edges).distinct()).distinct(), label)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select("v", "v").distinct()
    )
