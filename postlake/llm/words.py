"""Words of many texts at once: 64-bit hashes and places, without a Python object per word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
#: Bytes that make up words: letters, digits and all that is not ASCII; or all but white space.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
SPACED = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
BASE = 0x9E3779B97F4A7C15
_BACK = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A number for each byte, the same for a letter of A-Z in either case.
_VALUES = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], U) + U(1))
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, _BACK)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


class Words(NamedTuple):
    """Words of a run of texts in order.

    ``first[i]:first[i + 1]`` are the words of text i, ``owner`` their texts, ``starts`` and ``ends`` their
    bytes in ``buffer``, text i beginning at ``at[i]`` there; ``sums`` serves hashes of parts of words.
    """

    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    buffer: bytes
    sums: np.ndarray

    def head_hashes(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of each word, of the whole word where it is shorter."""
        return _spans(self.sums, self.starts, np.minimum(self.starts + n, self.ends))


def _spans(sums, starts, ends):
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])


def words(texts: list[bytes], kind: np.ndarray = LETTERS) -> Words:
    """Split texts into words of ``kind``; A-Z count as a-z."""
    buffer = b"\n".join(texts) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    inside = kind[data].view(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUES[data] * _powers(len(data) + 1)[0][:len(data)], out=sums[1:])
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, at)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(_spans(sums, starts, ends), first, owner, starts, ends, at, buffer, sums)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words by their first word, and which of them lie in one text."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    total = np.zeros(n, U)
    for j in range(k):
        total = total * U(BASE) + w.hashes[j:j + n]
    return mix(total), w.owner[:n] == w.owner[k - 1:]


def long_grams(w: Words, k: int) -> np.ndarray:
    """Hashes of runs of ``k`` words by their first word, at a cost that does not depend on ``k``."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    ahead, back = _powers(len(w.hashes) + 1)
    sums = np.zeros(len(w.hashes) + 1, U)
    np.cumsum(w.hashes * ahead[:len(w.hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * back[:n])


def window_least(values: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each value and the next ``width - 1``, and where all of them are valid.

    Neighbours must belong to one text: a stretch of valid values never spans two, since the last
    values of a text are not valid.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    least, done = values, 1
    while done < width:  # least[i] covers values[i:i + done]
        step = min(done, width - done)
        least = np.minimum(least[:len(least) - step], least[step:])
        done += step
    bad = np.concatenate([[0], np.cumsum(~valid)])
    return least, bad[width:] == bad[:count]


def window_minima(values: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least of some ``width`` neighbours that are all valid (ties: all of them).

    A stretch shorter than ``width`` has no window.
    """
    chosen = np.zeros(len(values), bool)
    least, whole = window_least(values, valid, width)
    for j in range(width if len(least) else 0):
        chosen[j:j + len(least)] |= whole & (values[j:j + len(least)] == least)
    return chosen
