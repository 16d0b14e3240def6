"""Texts cut at spaces and line ends, so that Python handles each distinct stretch of a batch once.

Arrow cuts the texts and numbers the distinct stretches; what Python makes of each of them is put together
again by those numbers, as one buffer in which every text has its place.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Recent

#: Words and stretches of over so many letters aren't remembered.
LONG = 64
#: What may follow a word's letters without a space: all printable ASCII characters but letters and digits.
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches of the texts (null: empty); the number of each stretch in order; the bounds of each text in that order."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(pc.replace_substring(whole, "\n", " "), " ")
    bounds = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]


def latin(word: str) -> str | None:
    """A single word of Latin letters in lower case, None for anything else or what another normal form changes."""
    low = word.lower()
    if low.isalpha() and (low.isascii() or (max(low) < "\u0250" and unicodedata.is_normalized("NFC", word))):
        return low
    return None


def recall(known: Recent, key: str):
    """What is known of the key, or made now; what is made of a long one is forgotten."""
    return known[key] if len(key) <= LONG else known.make(key)


def together(pieces: list[bytes], order: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, list[int]]:
    """The pieces of all stretches in order, and the bounds of each text in that buffer."""
    taken = pa.array(pieces, pa.large_binary()).take(pa.array(order))
    _, at, data = taken.buffers()
    return memoryview(data or b""), np.frombuffer(at, np.int64, len(taken) + 1)[bounds].tolist()
