"""Words of whole Arrow string arrays as 64-bit hashes, without a Python
string per word. Words are runs of ASCII letters, digits, underscores and
non-ASCII characters other than Latin-1 signs and general or CJK punctuation;
lower-case the column first (``F.lower``) where case should not matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ampere.llm.tables import mix64

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_LONG = 48


def _is_word(data: np.ndarray) -> np.ndarray:
    """Per byte: part of a word."""
    out = _WORD_BYTE[data]
    signs = np.flatnonzero(data == 0xC2)  # U+0080 to U+00BF
    for k in range(2):
        out[np.minimum(signs + k, len(data) - 1)] = False
    lead = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] | 1) == 0x81) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80))
    for k in range(3):  # U+2000 to U+207F, U+3000 to U+303F
        out[lead + k] = False
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of every word of the UTF-8 bytes ``data``, whose rows
    begin at ``offsets`` (one more than rows)."""
    if len(data) < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _is_word(data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its row
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, start, stop), np.searchsorted(offsets, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial of its bytes and its
    size, mixed; all spans take a step together."""
    size = stop - start
    h = size.astype(np.uint64)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, _LONG + 1), side="right")  # spans of at least k bytes
    by_size, at = h[order], start[order]
    for k in range(min(_LONG, int(size.max(initial=0)))):
        n = live[k]
        by_size[:n] = by_size[:n] * np.uint64(0x9E3779B97F4A7C15) + data[at[:n] + k]
    for i in range(int(np.searchsorted(-size[order], -_LONG, side="left"))):  # longer spans: their later bytes too
        rest = data[at[i] + _LONG : at[i] + size[order[i]]]
        powers = np.full(len(rest), 0x9E3779B97F4A7C15, np.uint64).cumprod(dtype=np.uint64)
        by_size[i : i + 1] += (rest * powers).sum(dtype=np.uint64)
    h[order] = by_size
    return mix64(h)


def byte_slices(texts: pa.Array, rows: int = 256, most: int = 1_500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(begin, end, data, offsets)``: UTF-8 bytes of consecutive rows of at
    most ``most`` bytes together, a longer text being a slice of its own, and
    where each row begins (and the last ends). Null: empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), at + rows, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def slices(texts: pa.Array, rows: int = 256, most: int = 1_500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(begin, end, hash, row)``: the words of consecutive rows."""
    for begin, end, data, offsets in byte_slices(texts, rows, most):
        yield begin, end, *word_hashes(data, offsets)
