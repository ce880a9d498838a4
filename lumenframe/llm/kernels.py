"""Vectorised byte kernels: word spans, hashes of words, shingles and windows over whole batches of texts.

All hashes are 64-bit polynomial hashes modulo 2**64 of the substituted bytes with a
finalising mix; they do not depend on the process, the machine or the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial, its inverse modulo 2**64, and the multipliers of the mix.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BLOCK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_tables: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h = h * U64(MIX_1)
    h = h ^ (h >> U64(27))
    h = h * U64(MIX_2)
    return h ^ (h >> U64(31))


def byte_codes() -> np.ndarray:
    """A 64-bit code for each byte value."""
    if "codes" not in _tables:
        _tables["codes"] = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    return _tables["codes"]


def powers(n: int, base: int, name: str) -> np.ndarray:
    """The first n powers; those for a block are kept, more are made for the one long text that needs them."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        seq = np.full(max(n, BLOCK + 4096), base, dtype=U64)
        seq[0] = 1
        have = np.cumprod(seq, dtype=U64, out=seq)
        if n <= BLOCK + 4096:
            _tables[name] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = BASE**s times the hash of buf[s:e]."""
    out = np.empty(len(buf) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(byte_codes()[buf] * powers(len(buf), BASE, "up"), dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = powers(len(prefix), BASE_INV, "down")
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width bytes, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.empty(0, dtype=U64)
    return mix((prefix[width:] - prefix[:n]) * powers(n, BASE_INV, "down"))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside 0x20 and 0x09-0x0D."""
    word = np.empty(len(buf) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(SPACE[buf], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes in all; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) + 1 > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space after each, and where each starts (with the end as last)."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8), at


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of texts, and how many words each text has."""
    buf, at = joined(texts)
    if lower:
        buf = lower_ascii(buf)
    starts, ends = word_spans(buf)
    count = np.diff(np.searchsorted(starts, at))
    return span_hash(prefix_hash(buf), starts, ends), count


def shingle_sets(texts: list[bytes], width: int, lower: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of width words; the whole sequence where there are fewer words; empty without words."""
    out: list[np.ndarray] = []
    for i, j in blocks(texts):
        words, count = word_hashes(texts[i:j], lower)
        n = max(0, len(words) - width + 1)
        acc = np.zeros(n, dtype=U64)
        for k in range(width):
            acc = acc * U64(BASE) + words[k : k + n]
        acc = mix(acc)
        at = np.concatenate([[0], np.cumsum(count)])
        for x, c in zip(at[:-1].tolist(), count.tolist(), strict=True):
            if c >= width:
                out.append(np.unique(acc[x : x + c - width + 1]))
            elif c:
                h = U64(c)
                with np.errstate(over="ignore"):
                    for w in words[x : x + c]:
                        h = h * U64(MIX_1) + w
                out.append(mix(np.array([h], dtype=U64)))
            else:
                out.append(np.empty(0, dtype=U64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed longs, that identify a sorted set of hashes."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mix(np.array([s.sum(dtype=U64) + U64(len(s))], dtype=U64))
        b = mix(np.array([mix(s ^ U64(MIX_2)).sum(dtype=U64)], dtype=U64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def slide_min_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each start i of len(h)-w+1 spans, the position of the smallest of h[i:i+w], the leftmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    val, at = h.copy(), np.arange(len(h), dtype=np.int32)
    span = 1
    while span * 2 <= w:  # doubling: val[i] is the least of h[i:i+span]
        other, o_at = val[span:], at[span:]
        m = len(other)
        right = other < val[:m]
        val = np.where(right, other, val[:m])
        at = np.where(right, o_at, at[:m])
        span *= 2
    if span < w:
        shift = w - span
        other, o_at = val[shift : shift + n], at[shift : shift + n]
        right = other < val[:n]
        at = np.where(right, o_at, at[:n])
    return at[:n]
