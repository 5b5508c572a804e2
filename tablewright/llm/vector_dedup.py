"""Near-duplicate vectors by passes over sorted random projections.

Each pass concatenates the signs of random projections to a key, orders the vectors of a label by
it, and compares every vector with a bounded window of its neighbours. Close vectors agree on most
signs, so they stand near each other in most orders; what passes find is united. The mean of a label
is taken off before projecting, so that a direction that all share leaves the keys apart; cosines are
those of the vectors as they are. Passes are added until further ones connect nothing new.

Windows do not bound what is found in a large group: all vectors of a group that passes have
connected are compared with each other afterwards, tile by tile, and counted without making pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tablewright.llm.common import components, shuffle_partitions, stage

MIN_COSINE = 0.98
PASSES = 16
QUIET = 2  # rounds of passes without a new link, after which no more are made
WINDOW = 32
KEY_BITS = 32  # of a key at least; four more for each doubling of the largest label
MEANS = 256  # labels whose sums a task keeps at once
TILE = 128
ROWS_PER_TASK = 50_000
SEED = 7

_FOUND = "_boundary INT, _side INT, _pass INT, _label STRING, _node BIGINT, _vec BINARY, u BIGINT, v BIGINT"


def _matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, one per row."""
    made = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    # Scaled first, so that neither very large nor very small components spoil the norm.
    made = made / np.abs(made).max(axis=1, keepdims=True)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def _signs(seed: int, pass_: int, dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, pass_, dim]).standard_normal((dim, bits))


class _Forest:
    """Which nodes are connected already, within one task."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def _encode(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vector in batch.column(2).to_pylist():
                made = None
                if vector and None not in vector:
                    array = np.array(vector, kind)
                    made = array.tobytes() if np.isfinite(array).all() and array.any() else None
                out.append(made)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                ["_id", "_label", "_vec"],
            )

    return run


def _sums(kind: str):
    """Sums of the unit vectors of each label and length, some rows of each per task."""

    def rows(sums):
        keys, made = list(sums), list(sums.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([m[0].tobytes() for m in made], pa.binary()),
             pa.array([m[1] for m in made], pa.int64())],
            ["_label", "_length", "_sum", "_count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            places: dict[tuple[str, int], list[bytes]] = {}
            for label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places.setdefault((label, len(vector)), []).append(vector)
            for key, vectors in places.items():
                total = _matrix(vectors, kind).sum(axis=0)
                known = sums.setdefault(key, [np.zeros(len(total)), 0])
                known[0] = known[0] + total
                known[1] += len(vectors)
            if len(sums) > MEANS:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    return run


def _mean(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("_sum"))
    mean = total / sum(table.column("_count").to_pylist())
    return table.slice(0, 1).select(["_label", "_length"]).append_column(
        "_mean", pa.array([mean.tobytes()], pa.binary())
    )


def _project(kind: str, passes: range, seed: int, bits: int):
    """Every vector once per pass, with the key of that pass, which is made without the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                unit = _matrix([vectors[i] for i in rows], kind)
                part = batch.take(pa.array(rows))
                unit -= np.frombuffer(b"".join(part.column(3).to_pylist())).reshape(unit.shape)
                for p in passes:
                    at = (p, unit.shape[1], bits)
                    plane = known[at] if at in known else known.setdefault(at, _signs(seed, *at))
                    keys = np.packbits(unit @ plane > 0, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), p, np.int32)),
                            part.column(0),
                            pa.array([k.tobytes() for k in keys], pa.binary()),
                            part.column(1),
                            part.column(2),
                        ],
                        ["_pass", "_label", "_key", "_node", "_vec"],
                    )

    return run


def _compare(kind: str, window: int, min_cosine: float):
    """Forest edges of the verified pairs within the window, and the rows at both ends of a task,
    which have neighbours in the next one."""

    def found(us, vs):
        n = len(us)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.string()),
             none(pa.int64()), none(pa.binary()), pa.array(us, pa.int64()), pa.array(vs, pa.int64())],
            ["_boundary", "_side", "_pass", "_label", "_node", "_vec", "u", "v"],
        )

    def ends(rows, boundary, side):
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([boundary] * n, pa.int32()), pa.array([side] * n, pa.int32()),
             pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()),
             pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            ["_boundary", "_side", "_pass", "_label", "_node", "_vec", "u", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, forest = TaskContext.get().partitionId(), _Forest()
        first: list[tuple] = []
        last: list[tuple] = []
        for batch in batches:
            new = list(
                zip(*(batch.column(c).to_pylist() for c in ("_pass", "_label", "_node", "_vec")))
            )
            if len(first) < window:
                first += new[: window - len(first)]
            rows, us, vs = last + new, [], []
            # Runs of one pass, label and length; each is compared by itself.
            starts = [0] + [
                i for i in range(1, len(rows))
                if rows[i][:2] != rows[i - 1][:2] or len(rows[i][3]) != len(rows[i - 1][3])
            ] + [len(rows)]
            for a, b in zip(starts, starts[1:]):
                if b - a < 2 or b <= len(last):
                    continue
                unit = _matrix([r[3] for r in rows[a:b]], kind)
                for step in range(1, min(window, b - a - 1) + 1):
                    close = np.einsum("ij,ij->i", unit[step:], unit[:-step]) >= min_cosine
                    for i in np.flatnonzero(close):
                        u, v = rows[a + i + step][2], rows[a + i][2]
                        if forest.join(u, v):
                            us.append(u)
                            vs.append(v)
            if us:
                yield found(us, vs)
            last = rows[-window:]
        if first:
            yield ends(first, part - 1, 1)
            yield ends(last, part, 0)

    return run


def _across(kind: str, min_cosine: float):
    """Verified pairs between the last rows of a task and the first of the next."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        us, vs, forest = [], [], _Forest()
        before = [r for r in rows if r["_side"] == 0]
        after = [r for r in rows if r["_side"] == 1]
        same = lambda r: (r["_pass"], r["_label"], len(r["_vec"]))
        for group in {same(r) for r in before} & {same(r) for r in after}:
            a = [r for r in before if same(r) == group]
            b = [r for r in after if same(r) == group]
            cosine = _matrix([r["_vec"] for r in a], kind) @ _matrix([r["_vec"] for r in b], kind).T
            for i, j in np.argwhere(cosine >= min_cosine):
                if forest.join(a[i]["_node"], b[j]["_node"]):
                    us.append(a[i]["_node"])
                    vs.append(b[j]["_node"])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _count_tile(kind: str, min_cosine: float):
    """For each vector of one tile, how many rows of the other tile it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = row["_members"], row["_others"]
                cosine = _matrix([m["_vec"] for m in a], kind) @ _matrix([m["_vec"] for m in b], kind).T
                weights = np.array([m["_n"] for m in b], np.int64)
                links = ((cosine >= min_cosine) * weights).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["_class"] for m in a], pa.int64()), pa.array(links, pa.int64())],
                    ["_class", "_links"],
                )

    return run


def near_vectors(
    vectors: DataFrame,
    min_cosine: float = MIN_COSINE,
    passes: int = PASSES,
    window: int = WINDOW,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """``_id, n_links, component_id`` for every row of ``vectors``.

    Two vectors of one label and length are linked at a cosine of ``min_cosine`` or more, computed
    in double precision. Pairs are found by ``passes`` passes and as many again until ``QUIET`` times
    in a row these connect nothing new, so a pair that no pass brings together may be missed. ``n_links`` counts the other rows that a row links with, exact copies
    included; ``component_id`` is the smallest id that links lead to.

    Rows that link with nothing (NULL id, label or vector, NULL or non-finite components, all
    zeros, no components) have no links and their own id. Rows that repeat an id are rows like any
    other. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    wide = isinstance(vectors.schema[vector_column].dataType.elementType, DoubleType)
    kind, element = ("<f8", "double") if wide else ("<f4", "float")
    rows = stage(
        vectors.select(
            F.col(id_column).cast("bigint").alias("_id"),
            F.col(label_column).cast("string").alias("_label"),
            F.col(vector_column).cast(f"array<{element}>").alias("_vec"),
        ).mapInArrow(_encode(kind), "_id BIGINT, _label STRING, _vec BINARY"),
        "vectors",
    )
    usable = rows.where("_id IS NOT NULL AND _label IS NOT NULL AND _vec IS NOT NULL")
    classes = stage(
        usable.groupBy("_label", "_vec").agg(
            F.min("_id").alias("_node"), F.count(F.lit(1)).alias("_n")
        ),
        "vector-classes",
    )
    length = F.length("_vec")
    means = stage(
        classes.select("_label", "_vec")
        .mapInArrow(_sums(kind), "_label STRING, _length INT, _sum BINARY, _count BIGINT")
        .groupBy("_label", "_length")
        .applyInArrow(_mean, "_label STRING, _length INT, _mean BINARY"),
        "vector-means",
    )
    total, largest = (
        classes.groupBy("_label").agg(F.count(F.lit(1)).alias("_k")).agg(F.sum("_k"), F.max("_k")).first()
    )
    bits = -(-(KEY_BITS + 4 * (largest or 0).bit_length()) // 8) * 8
    n_tasks = max(shuffle_partitions(spark), -(-(total or 0) * passes // ROWS_PER_TASK))
    # Ties of keys are ordered anew in each pass.
    order = ["_pass", "_label", length, "_key", F.xxhash64("_node", "_pass"), "_node"]

    def links_of(numbers: range) -> DataFrame:
        compared = stage(
            classes.select("_label", "_node", "_vec", length.alias("_length"))
            .join(means, ["_label", "_length"])
            .select("_label", "_node", "_vec", "_mean")
            .mapInArrow(
                _project(kind, numbers, seed, bits),
                "_pass INT, _label STRING, _key BINARY, _node BIGINT, _vec BINARY",
            )
            .repartitionByRange(n_tasks, *order)
            .sortWithinPartitions(*order)
            .mapInArrow(_compare(kind, window, min_cosine), _FOUND),
            "vector-windows",
        )
        across = (
            compared.where("u IS NULL")
            .groupBy("_boundary")
            .applyInArrow(_across(kind, min_cosine), "u BIGINT, v BIGINT")
        )
        return stage(compared.where("u IS NOT NULL").select("u", "v").unionAll(across), "vector-pairs")

    # An id that is repeated with another vector connects both classes.
    repeated = usable.groupBy("_id").agg(F.count(F.lit(1)).alias("_r")).where("_r > 1").select("_id")
    same_id = (
        usable.join(repeated, "_id")
        .join(classes, ["_label", "_vec"])
        .select(F.col("_id").alias("u"), F.col("_node").alias("v"))
    )
    edges = links_of(range(passes)).unionAll(same_id)
    found = stage(components(edges, "vector-links"), "vector-found")
    done, quiet = passes, 0
    # A label that one window holds is compared whole by the first pass.
    while (largest or 0) > window + 1 and quiet < QUIET:
        more = links_of(range(done, done + passes))
        done += passes
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        new = (
            more.join(of("u"), "u", "left")
            .join(of("v"), "v", "left")
            .select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
            .where("u != v")
        )
        if new.isEmpty():
            quiet += 1
            continue
        quiet = 0
        known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = stage(components(known.unionAll(new), "vector-links"), "vector-found")
    grouped = stage(
        classes.join(found, F.col("_node") == F.col("node"), "left").select(
            "_label", "_vec", "_node", "_n", "component", F.xxhash64("_label", "_vec").alias("_class")
        ),
        "vector-groups",
    )
    members = grouped.where("component IS NOT NULL")
    # Staged, so that the join to it is a broadcast or between two exchanges: a large group is split.
    sizes = stage(
        members.groupBy("component").agg(F.count(F.lit(1)).alias("_size")), "vector-sizes"
    )
    tile = F.pmod("_class", F.ceil(F.col("_size") / TILE))
    tiles = stage(
        members.join(sizes, "component")
        .withColumn("_tile", tile)
        .groupBy("component", "_label", F.length("_vec").alias("_length"), "_tile")
        .agg(F.collect_list(F.struct("_class", "_vec", "_n")).alias("_members")),
        "vector-tiles",
    )
    others = tiles.select(
        "component", "_label", "_length", F.col("_members").alias("_others")
    )
    links = (
        tiles.join(others, ["component", "_label", "_length"])
        .select("_members", "_others")
        .mapInArrow(_count_tile(kind, min_cosine), "_class BIGINT, _links BIGINT")
    )
    counted = links.groupBy("_class").agg(F.sum("_links").alias("_links"))
    labelled = grouped.join(counted, "_class", "left").select(
        "_label",
        "_vec",
        (F.coalesce("_links", "_n") - 1).alias("_links"),
        F.coalesce("component", "_node").alias("_component"),
    )
    return rows.join(labelled, ["_label", "_vec"], "left").select(
        "_id",
        F.when(F.col("_id").isNull(), 0).otherwise(F.coalesce("_links", F.lit(0)))
        .cast("bigint").alias("n_links"),
        F.when(F.col("_id").isNull(), None).otherwise(F.coalesce("_component", "_id"))
        .alias("component_id"),
    )

