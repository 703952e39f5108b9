"""Word shingles of whole texts, vectorised over Arrow batches.

A text's words are the runs of bytes other than 0x20 and 0x09-0x0D after
lower-casing A-Z. Its set holds the 64-bit hashes of its distinct shingles of
``size`` words; a text with fewer words (but at least one) has its whole
sequence as its only shingle; a null, empty or blank text has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts in order, and where each text's words begin (one more entry ends the last)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not filled.all():  # blanks at either end of a text leave empty strings
        ends = np.concatenate([[0], np.cumsum(filled)])[ends]
        codes = codes[filled]
    return (table[codes] if len(table) else np.zeros(0, np.uint64)), ends


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words, ends = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            rolled = mix(rolled + words[k : k + len(rolled)] * (_STEP + np.uint64(2 * k)))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    one = mix(one * _STEP + w)
                yield mix(one + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
