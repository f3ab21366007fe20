"""Words of texts as 64-bit hashes, with numpy, a bounded number of bytes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np

SEGMENT = 1 << 18


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte value (capitals A-Z as small letters; 0 for white space), and what is white space."""
    t = np.frombuffer(hashlib.shake_128(b"word").digest(8 * 256), np.uint64).copy() | np.uint64(1)
    t[65:91] = t[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return t, space


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in these bytes, and where each starts."""
    table, space = _tables()
    inside = ~space[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    length = ends - starts
    power = np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    within = np.arange(len(at)) - np.repeat(first, length)
    h = np.add.reduceat(table[data[at]] * power[within], first)
    return mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order; short texts are hashed together, long ones in segments."""
    waiting: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if waiting:
            joined = np.frombuffer(b"\n".join(waiting), np.uint8)
            h, starts = _segment(joined)
            ends = np.cumsum([len(w) + 1 for w in waiting])
            yield from np.split(h, np.searchsorted(starts, ends[:-1]))
            waiting.clear()

    for text in texts:
        raw = (text or "").encode()
        if len(raw) <= SEGMENT:
            waiting.append(raw)
            size += len(raw)
            if size > SEGMENT:
                yield from flush()
                size = 0
            continue
        yield from flush()
        size, parts, at = 0, [], 0
        space = _tables()[1]
        while at < len(raw):
            end = min(len(raw), at + SEGMENT)
            while end < len(raw) and not space[raw[end]]:
                end += 1
            parts.append(_segment(np.frombuffer(raw, np.uint8, end - at, at))[0])
            at = end
        yield np.concatenate(parts)
    yield from flush()


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of `width` words; of all words, if they are fewer; none of none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = mix(out + words[k : k + n])
    return out


def as_items(values: np.ndarray) -> np.ndarray:
    """A multiset as a set: equal values, in turn, become different items (value, 0), (value, 1), ..."""
    v = np.sort(values)
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    turn = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
    return np.sort(np.where(turn == 0, v, mix(v + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))))


#: What `measures` counts of a text, in the order of its columns.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_capitals", "n_digits", "n_marks", "n_lines", "n_dup_lines", "n_distinct")
_CLASSES = {"n_symbols": b"#*$%&|<>", "n_bangs": b"!", "n_capitals": bytes(range(65, 91)), "n_digits": bytes(range(48, 58)), "n_marks": b".,;:?"}


@cache
def _class_masks() -> np.ndarray:
    """(classes, 256): which byte values each class counts; the last row: bytes that begin a character of a word."""
    out = np.zeros((len(_CLASSES) + 1, 256), np.uint8)
    for row, chars in zip(out, _CLASSES.values()):
        row[list(chars)] = 1
    out[-1] = ~_tables()[1] & (np.arange(256) & 0xC0 != 0x80)
    return out


def measures(texts: list[str | None]) -> np.ndarray:
    """(texts, MEASURED) as doubles; distinct words without regard to capitals A-Z."""
    return described(texts, 0, 0, 0)[0]


def described(texts: list[str | None], words: int, pairs: int, marks: int) -> tuple[np.ndarray, np.ndarray]:
    """`measures`, and how often the text's words, pairs of words and runs of three bytes fall into so many buckets of their
    hashes (powers of two), each group as square roots of shares: a group's squares sum to 1, or 0 without such a part."""
    out, grams = np.zeros((len(texts), len(MEASURED))), np.zeros((len(texts), words + pairs + marks))
    for row, gram, text, found in zip(out, grams, texts, word_hashes(texts)):
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        seen = np.bincount(data, minlength=256)
        n_lines, n_dup = raw.count(b"\n") + 1, 0
        if n_lines > 1:
            lines = [x for x in raw.split(b"\n") if x.strip()]
            n_dup = len(lines) - len(set(lines))
        by_class = _class_masks() @ seen
        row[:] = (len(found), by_class[-1], *by_class[:-1], n_lines, n_dup, len(np.unique(found)))
        if words:
            gram[:words] = _shares(found, words)
        if pairs and len(found) > 1:
            gram[words : words + pairs] = _shares(shingles(found, 2), pairs)
        if marks and len(data) > 2:
            a = data.astype(np.uint32)
            code = ((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) + np.uint32(1)) * np.uint32(0x9E3779B1)
            gram[words + pairs :] = _shares(code, marks)
    return out, grams


def _shares(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Square roots of the shares of hashes in each bucket, which their leading bits name."""
    shift = hashes.dtype.type(hashes.dtype.itemsize * 8 - (buckets.bit_length() - 1))
    return np.sqrt(np.bincount((hashes >> shift).astype(np.int64), minlength=buckets) / max(1, len(hashes)))
