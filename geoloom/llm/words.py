"""Word hashes of many texts at once, for the operators that work on token positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

#: Words of texts that are worked on together.
FLAT_WORDS = 400_000
#: Words that a process keeps hashed; the table is begun anew beyond it.
TABLE_WORDS = 150_000

_ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+").findall


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > TABLE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case; all beyond ASCII counts as letters."""
    return _ALNUM(text.lower().encode()) if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def flat(batches: Iterator[pa.RecordBatch], split, text_at: int = 1) -> Iterator[tuple[list[int], pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(row numbers, their batch, all words' hashes, offsets) of a bounded number of words at a time."""
    for batch in batches:
        rows: list[int] = []
        parts: list[np.ndarray] = []
        held = 0
        for k, text in enumerate(batch.column(text_at)):
            own = hashed(split(text.as_py()))
            rows.append(k)
            parts.append(own)
            held += len(own)
            if held >= FLAT_WORDS:
                yield rows, batch, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                rows, parts, held = [], [], 0
        if rows:
            yield rows, batch, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def gram_hash(h: np.ndarray, offsets: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash at each place of the words at the offsets from it; places run to len(h) - max(offsets)."""
    n = max(0, len(h) - max(offsets))
    out = np.full(n, np.uint64(salt), np.uint64)
    for o in offsets:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[o : o + n]
        out ^= out >> np.uint64(29)
    return mix64(out)
