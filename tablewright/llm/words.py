"""Words of many texts at once, inside a task."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (NULL: none) in one array, and where those of each text begin."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(trimmed)
    # A text without words gives one empty word.
    none = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    sizes = np.where(none, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = pc.list_flatten(lists)
    if none.any():
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    return words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
