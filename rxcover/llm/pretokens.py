"""Splitting many texts at once into the pre-tokens of byte-level BPE.

The pieces are those of public_tokenizers.PATTERN:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex

from rxcover.llm.textvec import mix, span_hashes

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """Of every code point whether it is a letter, a number, white space or something else."""
    table = np.zeros(0x110000, dtype=np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[[points[m.start()], points[m.end() - 1]]] = kind
            table[points[m.start()] : points[m.end() - 1] + 1] = kind
    table[0xD800:0xE000] = _OTHER
    return table


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of the texts start; a piece ends where the next one starts."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = _classes().take(points)
    n = len(points)
    first = np.zeros(n + 1, dtype=bool)  # of a text
    first[np.searchsorted(leads, offsets)] = True
    first[n] = True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else of the same text stands apart, or goes with it if it is a blank.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n])
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    # Contractions.
    marks = np.flatnonzero((points == 39) & starts)
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        cut = np.concatenate([first, np.ones(2, bool)])
        one, two = padded[marks + 1], padded[marks + 2]
        near, nearer = ~cut[marks + 1], ~cut[marks + 1] & ~cut[marks + 2]
        single = near & np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(marks), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            double |= nearer & (one == ord(a)) & (two == ord(b))
        starts[marks[single | double] + 1] = False
        ends = np.concatenate([marks[single] + 2, marks[double] + 3])
        starts[ends[ends < n]] = True
    return leads[starts]


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces: a 64-bit hash of each distinct one, the place of its first occurrence, and each piece's number.

    Pieces with equal hashes are also compared by their bytes, and kept apart by
    a second hash if those differ.
    """
    lengths = np.diff(np.append(starts, len(data)))
    hashes = span_hashes(data, starts, starts + lengths)
    found, index, inverse = _numbered(hashes)
    if _equal(data, starts, starts[index][inverse], lengths, lengths[index][inverse]):
        return found, index, inverse
    check = span_hashes(data, starts, starts + lengths, 1)
    both = np.stack([hashes, check], axis=1)
    _, index, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    return mix(hashes[index] ^ check[index], 77), index, inverse


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with indices and inverse; only the distinct hashes are sorted."""
    coded = pa.array(hashes).dictionary_encode()
    found, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    # Codes are given in the order of first occurrence.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    order = found.argsort()
    rank = np.empty(len(found), dtype=np.int64)
    rank[order] = np.arange(len(found))
    return found[order], first[order], rank[codes]


def _equal(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray, other_lengths: np.ndarray) -> bool:
    """Whether the pieces, which follow one another, all equal those at `others`."""
    if not np.array_equal(lengths, other_lengths):
        return False
    at = np.repeat(others - starts, lengths)
    at += np.arange(len(data))
    return np.array_equal(data.take(at), data)
