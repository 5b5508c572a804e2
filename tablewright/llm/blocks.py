"""Lookups from texts to a large table, block by block.

A corpus has more tokens than can be joined one by one: a row per token costs several times the
text. Texts are therefore dealt to blocks of bounded size by a hash of their id. A block asks once
for each distinct key it holds, and gets the answers in the order of its questions. What moves is
the text, compressed, and a few bytes per distinct key and block. A lost task asks again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

BLOCK_BYTES = 16 << 20
LEAST_BLOCKS = 48
PACK_BYTES = 12 << 20


def n_blocks(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(LEAST_BLOCKS, -(-n_bytes // block_bytes))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeeze_numbers(numbers: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes, byte by byte, so that high bytes of small numbers vanish."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return squeeze(planes.tobytes())


def expand_numbers(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(expand(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def packed(texts: DataFrame, blocks: int) -> DataFrame:
    """``_block, _blob``: the rows ``_id, _text, _use`` in compressed parts of blocks.

    The block of a row depends on its id and text alone, so every run deals alike; rows that share
    an id, or have none, spread by their texts.
    """
    rows = texts.select(
        F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int").alias("_block"),
        "_id",
        "_text",
        "_use",
    )

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.sort_by([("_block", "ascending")])
        block = table.column("_block").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        numbers, blobs = [], []
        for a, b in zip(cuts, cuts[1:]):
            part = table.slice(a, b - a).select(["_id", "_text", "_use"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_table(part)
            numbers.append(int(block[a]))
            blobs.append(squeeze(sink.getvalue().to_pybytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["_block", "_blob"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield from pack(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from pack(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "_block INT, _blob BINARY")


def unpacked(blobs: list[bytes]) -> tuple[list, list[bytes], list[int]]:
    """Ids, texts and uses of the parts of one block, ordered by all three."""
    rows = []
    for blob in blobs:
        table = pa.ipc.open_stream(expand(blob)).read_all()
        rows += zip(*(table.column(c).to_pylist() for c in ("_id", "_text", "_use")))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return tuple([r[i] for r in rows] for i in range(3))
