"""Word, line and character statistics of whole texts, by array operations over the UTF-8 bytes of a batch.

Words are `[^\\x20\\x09-\\x0D]+`. Equal words, lines and 8-word windows of one text are found by 64-bit hashes. Those of up to 64 bytes are
sums over powers of a base, which known sequences of bytes could make collide if base and table were known; so each process draws
its own. Longer segments are hashed by blake2b with a key of the process. The statistics do not depend on what is drawn.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa

from ledgerloom.llm.common import CHUNK_BYTES, string_bytes

#: Fixed values of the contract: symbols, and what separates words.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8
LONG_SEGMENT = 64
#: What a quality model sees of a text. Ratios, so that a text and its repetition look alike.
FEATURES = (
    "log_words", "word_length", "symbol_rate", "pipe_rate", "bang_rate", "upper_rate", "repeat_rate", "dup_line_rate", "adjacent_rate", "distinct_rate", "stop_rate", "comma_rate", "digit_rate", "line_rate", "other_rate", "long_word_rate",
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SECRET = os.urandom(32)
_rng = np.random.default_rng(int.from_bytes(_SECRET, "little"))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
#: 3 modulo 8: of such a base the powers that sums of few terms can cancel by have the fewest factors of two.
_P = _rng.integers(0, 2**61, dtype=np.uint64) * np.uint64(8) + np.uint64(3)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segment_hashes(raw: np.ndarray, sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes."""
    h = _mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_SEGMENT):
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, key=_SECRET).digest(), "little")
    return h


def later_copies(key: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _chunk(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_docs, n = len(off) - 1, len(raw)
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    hist = np.bincount(doc * 256 + raw, minlength=256 * n_docs).reshape(n_docs, 256)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    blank = space[raw]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    edge = np.concatenate([[True], blank]) | first  # before byte i stands a space or the text's start
    starts = np.flatnonzero(~blank & edge[:-1])
    last = np.concatenate([blank[1:], [True]]) | first[1:]
    if n:
        last[-1] = True
    ends = np.flatnonzero(~blank & last) + 1
    word_doc = doc[starts]
    bounds = np.searchsorted(word_doc, np.arange(n_docs + 1))
    n_words = np.diff(bounds)
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[:n], out=sums[1:])
    words = segment_hashes(raw, sums, inverse, starts, ends)
    salt = _mixed(np.arange(1, n_docs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    total = np.concatenate([[0], np.cumsum(blank)])
    # lines that hold a word
    newline = raw == 10
    line_starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(newline) + 1]))
    line_starts = line_starts[line_starts < n]
    line_ends = np.minimum(np.concatenate([line_starts[1:], [n]]), off[doc[line_starts] + 1]) if len(line_starts) else line_starts
    line_ends = np.where((line_ends > line_starts) & newline[np.maximum(line_ends - 1, 0)], line_ends - 1, line_ends) if len(line_starts) else line_ends
    full = total[line_ends] - total[line_starts] < line_ends - line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = doc[line_starts]
    copies = later_copies(segment_hashes(raw, sums, inverse, line_starts, line_ends) ^ salt[line_doc])
    n_dup = np.bincount(line_doc[copies], minlength=n_docs)
    n_lines = np.bincount(line_doc, minlength=n_docs)
    # words in windows found twice or more
    n_repeat = np.zeros(n_docs, np.int64)
    m = len(words) - WINDOW + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + m]
        h = _mixed(h) ^ salt[word_doc[:m]]
        inside = np.flatnonzero(word_doc[:m] == word_doc[WINDOW - 1 :])
        h = h[inside]
        s = np.sort(h)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            at = inside[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
            cover = np.zeros(len(words) + WINDOW, np.int32)
            cover[at] += 1
            cover[at + WINDOW] -= 1
            n_repeat = np.bincount(word_doc[np.cumsum(cover[: len(words)]) > 0], minlength=n_docs)
    own = words ^ salt[word_doc]
    distinct = n_words - np.bincount(word_doc[later_copies(own)], minlength=n_docs)
    adjacent = np.bincount(word_doc[1:][own[1:] == own[:-1]], minlength=n_docs)
    length = ends - starts
    long_words = np.bincount(word_doc[length > 24], minlength=n_docs)
    short = np.bincount(word_doc[length <= 3], minlength=n_docs)
    bytes_in = lambda chars: hist[:, list(chars)].sum(1)
    word_chars = hist.sum(1) - hist[:, 128:192].sum(1) - bytes_in(SPACES)
    symbols = bytes_in(SYMBOLS)
    base = np.stack([n_words, word_chars, symbols, n_dup, n_repeat], axis=1)
    some = np.maximum(n_words, 1).astype(float)
    chars = np.maximum(word_chars, 1).astype(float)
    upper, lower = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1)
    other = hist[:, 33:127].sum(1) - upper - lower - symbols - hist[:, 48:58].sum(1) - bytes_in(b".,!")
    features = np.stack([
        np.log1p(n_words), word_chars / some, symbols / some, hist[:, ord("|")] / some, hist[:, ord("!")] / some, upper / np.maximum(upper + lower, 1), n_repeat / some, n_dup / np.maximum(n_lines, 1),
        adjacent / some, distinct / some, short / some, bytes_in(b".,") / some, hist[:, 48:58].sum(1) / chars, n_lines / some, other / chars, long_words / some,
    ], axis=1)
    return base, features


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text (null: empty) the columns BASE (integers) and FEATURES (floats)."""
    raw, off = string_bytes(texts)
    base, features, start = [], [], 0
    while start < len(off) - 1:
        end = max(start + 1, int(np.searchsorted(off, off[start] + CHUNK_BYTES, "right")) - 1)
        b, f = _chunk(raw[off[start] : off[end]], off[start : end + 1] - off[start])
        base.append(b)
        features.append(f)
        start = end
    if not base:
        return np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate(base), np.concatenate(features)
