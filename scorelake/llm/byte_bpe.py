"""Byte-level BPE by monoid tree reduction.

A match of the split pattern is encoded as a tree: its leaves are LEAF_BYTES bytes each, and the id sequences of neighbours
are joined, level by level. A join re-encodes the bytes of a window around the boundary and widens it until the
window's outer ids are compatible with their neighbours outside. Two neighbouring ids are compatible if
encoding their joined bytes gives just these two; a sequence whose neighbours are all compatible is the
encoding of its bytes, so from then on nothing outside the window can change. Decoding joins the
ids' bytes up the same tree.

Texts are worked off in chunks, every distinct slice of a chunk once; slices that were seen lately are
remembered. The ids of all new matches' parts lie in one array, and all joins of a level are done side by side: a join whose
boundary is compatible just drops the boundary, one whose smallest window suffices gets that window's ids, and the others
widen theirs one by one. Byte strings of one length that must be merged are rows of a matrix.

A slice is a run of letters, digits or marks with the blank before it, so nearly always one match; it begins
before a blank that something visible follows, or where ASCII and Latin-1 change from one kind to another, and no match of the
pattern spans such a place. Where anything else stands, the slice goes on to the next such blank, and the pattern cuts it.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Memo, Recent, held, map_batches
from scorelake.llm.pieces import FEED, LATIN, SPACE, chunks, distinct, put, runs

LEAF_BYTES = 3
#: Byte strings of more than SHORT_BYTES are merged by a heap; fewer than FEW of one length one by one.
SHORT_BYTES, FEW = 64, 12
MOST_PIECES, MOST_PAIRS, LONGEST_KEPT = 300_000, 400_000, 64
#: Above every rank; a place behind a row's last id.
_NONE, _GONE = 1 << 30, -1
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[33:127] = MARK
_KIND[[SPACE, FEED]] = BLANK
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), LATIN]] = LETTER
_KIND[48:58] = DIGIT
_KIND[ord("'")] = ODD
#: Bytes that begin a visible character: those of ASCII, and first bytes under which there is no white space.
_SEEN = np.zeros(256, bool)
_SEEN[[*range(33, 127), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._find = regex.compile(pattern).findall
        self._byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        halves = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self._pair_keys, self._pair_ranks = np.array(sorted(halves), np.int64).reshape(-1, 2).T.copy()
        self._forget()
        self._pieces, self._windows = Recent(MOST_PIECES), Memo(MOST_PAIRS)
        self._alone = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        # By id: the bytes it decodes to, and its decimal digits with a space behind them.
        self._bytes = pa.array([self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)], pa.large_binary())
        self._shown = pa.array([b"%d " % i for i in range(len(self._bytes))], pa.large_binary())

    def _merge(self, data: bytes) -> list[int]:
        """The lowest-ranked pair is merged again and again, the leftmost first."""
        if len(data) > SHORT_BYTES:
            return self._merge_long(data)
        ranks, none = self.ranks, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs; entries of pairs that are gone are passed over."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if j >= n or j == 0 or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (rank, i, end[stop]))
            if (h := before[i]) >= 0 and (rank := ranks.get(data[h:stop])) is not None:
                heappush(heap, (rank, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NONE for those that don't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        return np.where((self._pair_keys[at] == keys) & (left >= 0) & (right >= 0), self._pair_ranks[at], _NONE)

    def _merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """_merge for many byte strings of one length, a row each; _GONE fills up the rows of ids."""
        ids, n = self._byte_ids[rows], rows.shape[1]
        out, of, place = np.full_like(ids, _GONE), np.arange(len(ids)), np.arange(n)
        pairs = self._pair_rank(ids[:, :-1], ids[:, 1:])
        while len(of):
            at = pairs.argmin(axis=1)
            low = pairs[np.arange(len(of)), at]
            merges = low < _NONE
            out[of[~merges]] = ids[~merges]
            of, ids, pairs, at, low = of[merges], ids[merges], pairs[merges], at[merges], low[merges]
            row = np.arange(len(of))
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=_GONE), place + (place > at[:, None]), axis=1)
            ids[row, at] = low
            pairs = np.take_along_axis(np.pad(pairs, ((0, 0), (0, 1)), constant_values=_NONE), place[:-1] + (place[:-1] > at[:, None]), axis=1)
            after, before = np.flatnonzero(at < n - 1), np.flatnonzero(at > 0)
            pairs[after, at[after]] = self._pair_rank(ids[after, at[after]], ids[after, at[after] + 1])
            pairs[before, at[before] - 1] = self._pair_rank(ids[before, at[before] - 1], ids[before, at[before]])
        return out

    def _merge_all(self, strings: list[bytes]) -> list[list[int]]:
        """_merge for many byte strings, those of one length side by side."""
        by_length, out = defaultdict(list), [[]] * len(strings)
        for k, data in enumerate(strings):
            by_length[len(data)].append(k)
        for n, places in by_length.items():
            if len(places) < FEW or n > SHORT_BYTES or n < 2:
                for k in places:
                    out[k] = self._merge(strings[k])
                continue
            rows = self._merge_rows(np.frombuffer(b"".join([strings[k] for k in places]), np.uint8).reshape(-1, n))
            for k, row, size in zip(places, rows.tolist(), (rows != _GONE).sum(axis=1).tolist(), strict=True):
                out[k] = row[:size]
        return out

    def _forget(self) -> None:
        """The table of pairs of ids: sorted keys, each one's place, and by place the encoding of the pair's bytes."""
        self._keys, self._places = np.empty(0, np.int64), np.empty(0, np.int64)
        self._inner: list[list[int]] = []
        self._facts = np.empty((0, 4), np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of pairs of ids in the table, which learns those that it doesn't have."""
        keys, back = np.unique(left << 32 | right, return_inverse=True)
        at = np.searchsorted(self._keys, keys)
        new = keys[self._keys[np.minimum(at, len(self._keys) - 1)] != keys] if len(self._keys) else keys
        if len(new):
            pairs = [(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()]
            made = self._merge_all([self.tokens[a] + self.tokens[b] for a, b in pairs])
            facts = [(ids[0], ids[-1], len(ids), len(ids) == 2 and ids[0] == a and ids[1] == b) for (a, b), ids in zip(pairs, made, strict=True)]
            before = np.searchsorted(self._keys, new)
            self._places = np.insert(self._places, before, len(self._inner) + np.arange(len(new)))
            self._keys = np.insert(self._keys, before, new)
            self._inner += made
            self._facts = np.concatenate([self._facts, np.array(facts, np.int64)])
            at = np.searchsorted(self._keys, keys)
        return self._places[at][back]

    def _window(self, data: bytes) -> list[int]:
        known = self._windows.get(data)
        if known is None:
            known = self._windows[data] = self._merge(data)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        return self._window(self.tokens[a] + self.tokens[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both; either side is an encoding and not empty."""
        i, j = 1, 1
        while True:
            inner = self._window(self.decode(left[len(left) - i :] + right[:j]))
            left_done = i == len(left) or self._compatible(left[-i - 1], inner[0])
            right_done = j == len(right) or self._compatible(inner[-1], right[j])
            if left_done and right_done:
                return left[: len(left) - i] + inner + right[j:]
            i, j = i if left_done else min(len(left), 2 * i), j if right_done else min(len(right), 2 * j)

    def _join_level(self, ids: np.ndarray, ends: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join the parts `right` to the ones before them; ends has where each part begins, with the end behind. Gives ids, and every part's size after it (0 for those in `right`)."""
        start, at, stop = ends[right - 1], ends[right], ends[right + 1]
        place = self._pairs(ids[at - 1], ids[at])
        first, last, size, same = self._facts[place].T
        changes = same == 0
        fits = np.ones(len(at), bool)
        for inside, test in ((at - 2 >= start, lambda k: (ids[at[k] - 2], first[k])), (at + 1 < stop, lambda k: (last[k], ids[at[k] + 1]))):
            k = np.flatnonzero(changes & inside)
            if len(k):
                beside = self._pairs(*test(k))
                fits[k] &= self._facts[beside, 3] == 1
        sizes = np.diff(ends)
        sizes[right - 1] += sizes[right]
        sizes[right] = 0
        keep, put_at, made = np.ones(len(ids), bool), [], []
        small, wide = np.flatnonzero(changes & fits), np.flatnonzero(changes & ~fits)
        keep[at[small] - 1] = keep[at[small]] = False
        sizes[right[small] - 1] += size[small] - 2
        inner = self._inner
        for k, p in zip(at[small].tolist(), place[small].tolist(), strict=True):
            put_at.append(k - 1)
            made.append(inner[p])
        for k in wide.tolist():
            a, b, c = int(start[k]), int(at[k]), int(stop[k])
            joined = self.join(ids[a:b].tolist(), ids[b:c].tolist())
            keep[a:c] = False
            sizes[right[k] - 1] = len(joined)
            put_at.append(a)
            made.append(joined)
        if not made:
            return ids, sizes
        kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
        # In the order of their places, as nothing may be kept between two of them.
        by = np.argsort(np.array(put_at)).tolist()
        where = np.repeat(kept[[put_at[k] for k in by]], [len(made[k]) for k in by])
        return np.insert(ids[keep], where, [i for k in by for i in made[k]]), sizes

    def _trees(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of byte strings, end to end, and each one's number of ids."""
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        leaves = -(-sizes // LEAF_BYTES)
        of = np.repeat(np.arange(len(matches)), leaves)
        number = np.arange(len(of)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
        # Leaves as numbers: their bytes, and their length above these.
        data = np.concatenate([np.frombuffer(b"".join(matches), np.uint8), np.zeros(LEAF_BYTES, np.uint8)]).astype(np.int64)
        begin = np.repeat(np.cumsum(sizes) - sizes, leaves) + number * LEAF_BYTES
        length = np.minimum(LEAF_BYTES, sizes[of] - number * LEAF_BYTES)
        codes = length << 8 * LEAF_BYTES
        for k in range(LEAF_BYTES):
            codes |= np.where(k < length, data[begin + k], 0) << 8 * k
        kinds, back = np.unique(codes, return_inverse=True)
        made = self._merge_all([int(c).to_bytes(8, "little")[: int(c) >> 8 * LEAF_BYTES] for c in kinds])
        table = np.full((len(kinds), LEAF_BYTES), _GONE)
        for k, row in enumerate(made):
            table[k, : len(row)] = row
        ids = table[back]
        sizes = (ids != _GONE).sum(axis=1)
        ids = ids[ids != _GONE]
        while True:
            right = np.flatnonzero(number % 2 == 1)
            if not len(right):
                return ids, sizes
            ids, sizes = self._join_level(ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), right)
            left = number % 2 == 0
            number, sizes = number[left] // 2, sizes[left]

    def encode_matches(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as 32-bit integers, of matches of the pattern: a match that is a token is that, others are trees, whose levels are joined side by side."""
        if len(self._inner) > MOST_PAIRS:
            self._forget()
        self._windows.make_room()
        out = list(map(self._alone.get, pieces))
        trees = [k for k, ids in enumerate(out) if ids is None]
        if trees:
            ids, sizes = self._trees([pieces[k] for k in trees])
            data, ends = ids.astype("<i4").tobytes(), (4 * np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])).tolist()
            for k, a, b in zip(trees, ends[:-1], ends[1:], strict=True):
                out[k] = data[a:b]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_matches([piece.encode("utf-8", "surrogatepass") for piece in self._find(text)])), "<i4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _slices(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the slices of the chunk begin, with the end behind."""
        begins = np.zeros(len(data) + 1, bool)
        begins[:-2] = ((data[:-1] == SPACE) | (data[:-1] == FEED)) & _SEEN[data[1:]]
        begins[first - 1] = False  # a text's last blank: what follows is another text
        begins[first] = True
        kind, turns, simple, _ = runs(data, begins, _KIND, ODD)
        begins[1:-1] |= turns & simple[1:] & (kind[:-1] != BLANK)
        return np.flatnonzero(begins)

    def _code(self, slices: list[bytes]) -> list[bytes]:
        """The ids of slices, as 32-bit integers."""
        self._pieces.turn()
        made = list(map(self._pieces.get, slices))
        missing = [k for k, ids in enumerate(made) if ids is None]
        split = [(s,) if (s[1:] if s[0] == SPACE else s).isalpha() else [m.encode("utf-8", "surrogatepass") for m in self._find(s.decode("utf-8", "surrogatepass"))] for s in map(slices.__getitem__, missing)]
        ids, at = self.encode_matches([m for matches in split for m in matches]), 0
        for k, matches in zip(missing, split, strict=True):
            n = len(matches)
            made[k] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n
            if len(slices[k]) <= LONGEST_KEPT:
                self._pieces.young[slices[k]] = made[k]
        return made

    def round_trips(self, texts: pa.Array) -> list[tuple[memoryview, memoryview, int]]:
        """Of each text the decimal ids joined by spaces, the bytes they decode to, and the ids' number."""
        out = []
        for data, first in chunks(texts):
            if not len(data):
                out += [(memoryview(b""), memoryview(b""), 0)] * (len(first) - 1)
                continue
            starts = self._slices(data, first)
            numbers, found = distinct(data, starts)
            ids, at = put(numbers, self._code(found))
            at = at[np.searchsorted(starts, first)] // 4
            (shown, shown_at), (back, back_at) = (put(ids.view("<i4"), table) for table in (self._shown, self._bytes))
            shown, back, counts, shown_at, back_at = memoryview(shown), memoryview(back), np.diff(at).tolist(), shown_at[at].tolist(), back_at[at].tolist()
            out += [(shown[shown_at[k] : max(shown_at[k], shown_at[k + 1] - 1)], back[back_at[k] : back_at[k + 1]], n) for k, n in enumerate(counts)]
        return out


def coder(path: str, pattern: str) -> ByteBPE:
    return held((path, pattern), lambda: ByteBPE(path, pattern))


def byte_bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """docs: doc_id long, text string; other columns are ignored. Null text counts as empty.

    Returns for each row doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and
    decoded_sha256 (of the bytes that the ids decode to), and with_ids the ids as well. An empty text has no ids. Every row is
    coded by itself, so repeated rows and null doc_ids just stay. An empty table gives an empty one. Any pattern must split
    as the docstring of this module says: no match has a blank but as its first character or in a run of white space.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = coder(path, pattern).round_trips(batch.column("text"))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        columns = [batch.column("doc_id"), pa.array([m[2] for m in made], pa.int64()), pa.array([sha(m[0]) for m in made], pa.string()), pa.array([sha(m[1]) for m in made], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array([[int(i) for i in bytes(m[0]).split()] for m in made], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
