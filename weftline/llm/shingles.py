"""Words and five-word shingles as 64-bit numbers, in numpy.

ASCII letters are lowered; words are runs of anything but U+0020 and U+0009 to U+000D, found in
the UTF-8 bytes. A word's number mixes a polynomial of its bytes modulo 2**64, which sums over the whole
batch give for all of its words at once; a shingle's number mixes those of its words. Two
different shingles share a number with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import SUB_BYTES, sub_batches

WIDTH = 5
_GOLDEN, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: The polynomial's point, and its inverse modulo 2**64.
_POINT = 0xD6E8FEB86659FD93
_BACK = pow(_POINT, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def white_in(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)


#: A number for each byte, the same for A-Z and a-z.
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_UP, _DOWN = _powers(_POINT, 2 * SUB_BYTES), _powers(_BACK, 2 * SUB_BYTES)


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all words of bytes that end with white space, and where each starts and ends."""
    if len(data) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = white_in(data)
    turns = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        turns = np.concatenate([[0], turns])
    starts, ends = turns[::2], turns[1::2]
    up, down = (_UP[: len(data)], _DOWN) if len(data) <= len(_UP) else (_powers(_POINT, len(data)), _powers(_BACK, len(data)))
    sums = np.cumsum(_OF_BYTE[data] * up, dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mixed((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN), starts, ends


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each ended by a line end, and where each text ends."""
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum([len(t) + 1 for t in texts])


def pieces(text: bytes, most: int = 2 * SUB_BYTES - 1):
    """Pieces of bounded size, cut after white space where the text has some, else after a longer word."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(bytes([c]), at, at + most) for c in b" \t\n\v\f\r") + 1
        if end <= at:
            found = [x for c in b" \t\n\v\f\r" if (x := text.find(bytes([c]), at + most)) >= 0]
            if not found:
                break
            end = min(found) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_numbers(texts: list[bytes]) -> list[np.ndarray]:
    """The numbers of each text's words."""
    if len(texts) == 1 and len(texts[0]) >= 2 * SUB_BYTES:
        return [np.concatenate([words_in(np.frombuffer(p + b"\n", np.uint8))[0] for p in pieces(texts[0])])]
    data, ends = joined(texts)
    numbers, starts, _ = words_in(data)
    return np.split(numbers, np.searchsorted(starts, ends[:-1]))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[str | None], width: int = WIDTH):
    """The sorted distinct shingles of each text; a shorter text's whole sequence is one shingle."""
    for a, b in sub_batches(texts):
        words = word_numbers([(t or "").encode("utf-8") for t in texts[a:b]])
        row = np.concatenate(words) if len(words) > 1 else words[0]
        n = len(row) - width + 1
        if n > 0:
            rolled = np.zeros(n, np.uint64)
            for j in range(width):
                rolled = rolled * _GOLDEN + row[j : j + n]
            rolled = mixed(rolled)
        at = 0
        for w in words:
            if len(w) >= width:
                yield distinct(rolled[at : at + len(w) - width + 1])
            elif len(w):
                h = np.zeros(1, np.uint64)
                for x in w:
                    h = h * _GOLDEN + x
                yield mixed(h + np.uint64(len(w) * 0x9E3779B1))
            else:
                yield np.zeros(0, np.uint64)
            at += len(w)


def digest_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set; with the set's size it stands for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), seed=len(shingles))).view(np.int64))
