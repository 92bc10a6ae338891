"""Fingerprint kernel of the SimHash operator (see simhash.py)."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included.

    A-Z are lower-cased; words are joined by one space; a text of fewer words than ``width`` is one
    shingle, a text without words (or null) has fingerprint 0. A bit is 1 if set in over half.
    """
    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    h = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, stops[width - 1 :])), np.uint64, len(words) - width + 1
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):  # bounded memory for very long texts
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64))[0])
