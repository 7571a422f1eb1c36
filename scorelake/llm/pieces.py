"""Arrow batches of texts cut into pieces, each distinct piece looked at once.

A chunk's bytes stay where Arrow has them: a piece is a slice, and the distinct slices come from Arrow's
dictionary encoding. What is made of a piece is put into the place of every slice by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked off at once; a longer text is a chunk of its own.
CHUNK = 8 << 20
SPACE, FEED = 32, 10
#: The first byte of the letters of Latin-1, and the second bytes of its two signs.
LATIN, SIGNS = 0xC3, (0x97, 0xB7)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of some of the texts and where each begins, with the end behind; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield raw[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
        at = stop


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of the slices between starts (the end of the data behind them): each one's number, and the distinct ones."""
    offsets = np.ascontiguousarray(starts, np.int64)
    slices = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = slices.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def put(numbers: np.ndarray, made: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """made[i] in place of each number i: the bytes end to end, and where each place's begin, with the end behind."""
    if not len(numbers):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    taken = (made if isinstance(made, pa.Array) else pa.array(made, pa.large_binary())).take(pa.array(numbers))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64, len(taken) + 1, taken.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8))[: ends[-1]], ends


def runs(data: np.ndarray, begins: np.ndarray, kind: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces, which begin where `begins` says: the kind of every byte, where the kind changes, which bytes' pieces
    are cut at such places (those without any odd byte), and the odd pieces' flags.

    `kind` says what a byte is; second bytes of Latin-1's multiplication and division signs become odd.
    """
    starts = np.flatnonzero(begins)
    of = kind[data]
    second = np.flatnonzero(data[:-1] == LATIN) + 1
    of[second[np.isin(data[second], SIGNS)]] = odd
    is_odd = np.logical_or.reduceat(of == odd, starts[:-1])
    return of, of[1:] != of[:-1], np.repeat(~is_odd, np.diff(starts)), is_odd
