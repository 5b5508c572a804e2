"""SimHash near-duplicates, found through a table of distances to reference fingerprints.

The table holds, for every distinct fingerprint, its Hamming distances to many references: one
base, one family for each block of bits (the base with one bit of the block turned over), and some
random ones. Distances differ by at most the distance of two fingerprints, so a pair whose distances
to any reference differ by more than that is discarded, and only the rest is compared.

Pairs are not all looked at. A family tells, by how its distances differ from the base's, whether
two fingerprints agree on its block, so with four blocks and at most two differing bits, the
coordinates of two families agree; fingerprints meet on those. Random references alone could not do
this: each would discard two thirds of the pairs at best, and what is left grows with the square.

Where more than ``BUCKET`` fingerprints meet on the same coordinates no pairs are made. Each of
them stands instead for itself and its 64 neighbours at one bit: two that are at most two bits apart
share one of these, and only such two. The links are the same, and the work is linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from tablewright.llm.common import components, stage, with_free_name

WORDS = 3
SEED = 42
MAX_BITS = 2
BLOCKS = 4
BUCKET = 64
RANDOM_REFERENCES = 32
CHUNK = 1 << 16  # shingles that are counted at once

_SIGNED = np.random.default_rng(20240607).integers(-(1 << 63), 1 << 63, RANDOM_REFERENCES + 1)
BASE, OTHERS = int(_SIGNED[0]), [int(x) for x in _SIGNED[1:]]


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text as a signed number; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = (
        map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
        if len(words) >= WORDS
        else iter([b" ".join(words)])
    )
    n, ones = 0, np.zeros(64, np.int64)
    while chunk := [xxh64_intdigest(gram, SEED) for gram in islice(grams, CHUNK)]:
        n += len(chunk)
        octets = np.array(chunk, ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``_id, _fp`` for every row: the majority of the bits of its word shingles' XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["_id", "_fp"])

    rows = documents.select(
        F.col(id_column).cast("bigint").alias("_id"),
        F.col(text_column).cast("binary").alias("_text"),
    )
    return rows.mapInArrow(run, "_id BIGINT, _fp BIGINT")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(classes: DataFrame) -> DataFrame:
    """Add ``_far``, distances to the random references, and ``_keys``, what the coordinates of
    each two families say."""
    fp = F.col("_fp")
    distances = lambda references: F.transform(
        F.array(*(F.lit(r) for r in references)), lambda r: _distance(fp, r).cast("tinyint")
    )
    family = distances([BASE ^ _bit(i) for i in range(64)])
    table = classes.select(
        "_node", "_fp", distances(OTHERS).alias("_far"), family.alias("_near"),
        _distance(fp, F.lit(BASE)).cast("tinyint").alias("_base"),
    )
    steps = F.transform("_near", lambda d: (d - F.col("_base")).cast("tinyint"))
    width = 64 // BLOCKS
    of = lambda block: F.slice("_steps", block * width + 1, width)
    keys = F.array(
        *(
            F.xxhash64(F.lit(i), *(of(block) for block in agree))
            for i, agree in enumerate(combinations(range(BLOCKS), BLOCKS - MAX_BITS))
        )
    )
    return table.withColumn("_steps", steps).select("_node", "_fp", "_far", keys.alias("_keys"))


def _links(classes: DataFrame, bucket: int) -> DataFrame:
    """Edges ``u, v`` of nodes whose fingerprints differ in at most ``MAX_BITS`` bits: all within
    small buckets, and as many as connect the same nodes within large ones."""
    keyed = pivot_table(classes).select("_node", "_fp", "_far", F.explode("_keys").alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    small = keyed.join(sizes.where(F.col("_size") <= bucket).select("_key"), "_key")
    other = small.select(
        "_key", *(F.col(c).alias(f"_other{c}") for c in ("_node", "_fp", "_far"))
    )
    largest_step = F.array_max(F.zip_with("_far", "_other_far", lambda a, b: F.abs(a - b)))
    pairs = (
        small.join(other, "_key")
        .where("_node < _other_node")
        .where(largest_step <= MAX_BITS)
        .where(_distance(F.col("_fp"), F.col("_other_fp")) <= MAX_BITS)
        .select(F.col("_node").alias("u"), F.col("_other_node").alias("v"))
    )
    crowded = keyed.join(sizes.where(F.col("_size") > bucket).select("_key"), "_key")
    around = F.array(
        F.col("_fp"), *(F.col("_fp").bitwiseXOR(F.lit(_bit(i))) for i in range(64))
    )
    spots = crowded.select("_node", "_fp").distinct().select(
        "_node", F.explode(around).alias("_spot")
    )
    centres = spots.groupBy("_spot").agg(F.min("_node").alias("_centre"), F.max("_node").alias("_m"))
    stars = (
        spots.join(centres.where("_centre < _m").select("_spot", "_centre"), "_spot")
        .where("_node != _centre")
        .select(F.col("_node").alias("u"), F.col("_centre").alias("v"))
    )
    return pairs.unionAll(stars)


def near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """``_id, _fp, component_id`` for every row of ``documents``.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest id that links
    lead to. Exact copies share a fingerprint and are one node, so they cost one row each and no
    pair. NULL, empty and blank texts have the fingerprint zero and link like any other.

    Rows that repeat an id keep their own fingerprint; links of both count for that id. A row
    without an id belongs to the component of its fingerprint, where a row with an id has the same
    one, and has NULL otherwise. An empty table gives no rows; other columns are not read.
    """
    rows = stage(fingerprints(documents, id_column, text_column), "fingerprints")
    classes = stage(
        rows.groupBy("_fp").agg(F.min("_id").alias("_node")).where("_node IS NOT NULL"),
        "fingerprint-classes",
    )
    # An id that is repeated with other texts is the node of several classes, and so connects them;
    # where it is not the smallest of a class, an edge to the smallest says the same.
    repeated = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    same_id = (
        rows.join(repeated, "_id")
        .join(classes, "_fp")
        .select(F.col("_id").alias("u"), F.col("_node").alias("v"))
    )
    found = components(_links(classes, bucket).unionAll(same_id), "simhash-links")
    labelled = classes.join(found, F.col("_node") == F.col("node"), "left").select(
        "_fp", F.coalesce("component", "_node").alias("component_id")
    )
    return rows.join(labelled, "_fp", "left").select("_id", "_fp", "component_id")


def with_fingerprints(documents: DataFrame, name: str, text_column: str = "text") -> DataFrame:
    """All columns of ``documents``, of any type, and the fingerprint of the text under ``name``."""
    columns = documents.columns
    schema = documents.select("*", F.lit(0).cast("bigint").alias(name)).schema
    for field in schema:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(len(columns))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], made], [*columns, name]
            )

    text = F.col(text_column).cast("binary").alias(with_free_name(documents, "text_"))
    return documents.select("*", text).mapInArrow(run, schema)


def drop_near_copies(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """``documents`` with one row of each group whose fingerprints are linked: the one of the
    smallest id (rows without an id come last), then of the smallest MD5 of the text.

    Groups are of fingerprints and not of ids, so rows that repeat an id and have unlike texts all
    stay, and rows without an id join the groups of their texts. NULL, empty and blank texts are one
    group. Of equal rows one stays. Columns may have any type and name; an empty table stays empty.
    """
    mark, number = (with_free_name(documents, n) for n in ("fingerprint_", "number_"))
    # Numbers are given once and written down, so that they name the same rows in both joins.
    rows = stage(
        with_fingerprints(documents, mark, text_column).withColumn(
            number, F.monotonically_increasing_id()
        ),
        "fingerprint-rows",
    )
    brief = rows.select(
        F.col(mark).alias("_fp"),
        F.struct(
            F.col(id_column).isNull().alias("_none"),
            F.col(id_column).alias("_id"),
            F.md5(text_column).alias("_md5"),
            F.col(number).alias("_nr"),
        ).alias("_place"),
    )
    marks = stage(brief.select("_fp").distinct(), "fingerprint-marks")
    links = _links(marks.select(F.col("_fp").alias("_node"), "_fp"), bucket)
    found = components(links, "simhash-groups").select(F.col("node").alias("_fp"), "component")
    grouped = brief.join(found, "_fp", "left").withColumn("_group", F.coalesce("component", "_fp"))
    first = grouped.groupBy("_group").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"))
    dropped = (
        grouped.join(first.where("_first != _last").drop("_last"), "_group")
        .where("_place != _first")
        .select(F.col("_place._nr").alias(number))
    )
    return rows.join(dropped, number, "left_anti").select(*documents.columns)
