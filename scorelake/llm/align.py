"""Cross-tokenizer alignment: which tokens of one tokenizer stand over which of another.

Token ends are bits, one for each byte of the text, packed into 64-bit words, a bitset for each tokenizer. Their AND has the
bytes where both end. The rank of such a cut, set bits in the words before plus those up to it in its own word, is the number of
tokens up to it, so two neighbouring cuts give a group's token ranges in either tokenizer, and a group's links are
the pairs of its tokens.

Texts are worked off in chunks (`pieces`), every distinct slice once. A slice begins at a single space between two visible
characters: A's pattern begins a match there, and no piece of B has a blank behind anything else, so both tokenizers end a token
before it, whatever stands beside it. That is checked where it is used; where it fails, slices are whole texts.

Pairs of ids are counted over all documents by two passes. The first writes, for each block of texts, its distinct pairs with
their number of documents, and for each document which of them it has. The second joins the summed counts to the
blocks' pairs, so what is shuffled are pairs by block and not by document, and brings them together with the block's documents.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import held, join_hot, map_batches, remove_folder, table
from scorelake.llm.pieces import LATIN, SPACE, chunks, distinct, put

BLANK = "▁"  # how a piece shows a space
#: Slices are given to the tokenizers in strings of so many bytes.
JOB, AT_ONCE = 1 << 15, 8
#: Bytes of text in a block of documents.
BLOCK = 4 << 20
#: A group with more pairs of tokens than this is expanded from its distinct ids and their numbers.
WIDE = 4096
_SEEN = np.zeros(256, bool)
_SEEN[33:127] = True
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
COLUMNS = [("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("pair", pa.int64()), ("number", pa.int32()), ("docs", pa.int64())]
SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, pair long, number int, docs long"


def bitset(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """Words of 64 bits; bit i says that a token ends with byte i. ends: numbers of bytes up to each end."""
    marks = np.zeros(-(-n_bytes // 64) * 64, bool)
    marks[ends - 1] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """The places of all set bits, ascending."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many set bits stand up to each place, itself included."""
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
    return before[word] + np.bitwise_count(words[word] & upto)


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones of Latin-1 for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self._a.encode_special_tokens = True
        of, entries = _byte_level(), self._a.get_vocab()
        shown = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            shown[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        sounds = [bytes([int(p[3:-1], 16)]) if self._b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = pa.array(shown, pa.large_binary()), pa.array(sounds, pa.large_binary())
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in s], np.int64) for s in (shown, sounds))
        #: Whether texts may be cut before a space.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for i, p in enumerate(pieces) if not (self._b.is_control(i) or self._b.is_unknown(i)))
        # An id's digits and what stands behind them: within a group, behind its last A, behind its last B.
        self.signs = pa.array([b"%d%s" % (i, s) for n, signs in ((len(shown), b",|"), (len(sounds), b",;")) for i in range(n) for s in (signs[:1], signs[1:])], pa.large_binary())
        self.first_b = 2 * len(shown)

    def encode(self, strings: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of strings that begin with a space; B puts its own in the place of that. A few strings at a time, as the libraries' own results are large."""
        a, b = [], []
        for k in range(0, len(strings), AT_ONCE):
            texts = [s.decode() for s in strings[k : k + AT_ONCE]]
            a += [np.array(e.ids, np.int64) for e in self._a.encode_batch_fast(texts, add_special_tokens=False)]
            b += [np.array(ids, np.int64) for ids in self._b.encode([t[1:] for t in texts], num_threads=1)]
        return a, b

    def same(self, string: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both id sequences stand for the string's bytes."""
        return all(put(ids, table)[0].tobytes() == string for ids, table in ((a, self.bytes_a), (b, self.bytes_b)))


class Groups:
    """The groups of strings, end to end. `whole` is false if a string's end isn't a cut."""

    def __init__(self, of: Tokenizers, a: np.ndarray, b: np.ndarray, sizes: np.ndarray):
        n_bytes, ends = int(sizes.sum()), np.cumsum(sizes)
        bits_a, bits_b = bitset(np.cumsum(of.sizes_a[a]), n_bytes), bitset(np.cumsum(of.sizes_b[b]), n_bytes)
        cuts = select(bits_a & bits_b)
        upto_a, upto_b = rank(bits_a, cuts), rank(bits_b, cuts)
        last = np.minimum(np.searchsorted(cuts, ends - 1), max(len(cuts) - 1, 0))
        self.whole = bool((cuts[last] == ends - 1).all()) if len(ends) else True
        self.a, self.b, self.of = a, b, of
        self.begin_a, self.begin_b = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
        self.size_a, self.size_b = upto_a - self.begin_a, upto_b - self.begin_b
        self.links = self.size_a * self.size_b
        #: Each string's first group, with the end behind.
        self.first = np.concatenate([[0], last + 1])

    def counts(self) -> np.ndarray:
        """A row for each string: tokens of A and B, groups, links."""
        sums = [np.concatenate([[0], np.cumsum(x)])[self.first] for x in (self.size_a, self.size_b, np.ones_like(self.links), self.links)]
        return np.diff(np.array(sums, np.int64), axis=1).T

    def shown(self) -> pa.Array:
        """Each string's groups, as `a1,a2|b1;`."""
        signs = np.empty(len(self.a) + len(self.b), np.int64)
        group_a, group_b = (np.repeat(np.arange(len(s)), s) for s in (self.size_a, self.size_b))
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.begin_a + self.size_a - 1] = 1
        last_b[self.begin_b + self.size_b - 1] = 1
        signs[np.arange(len(self.a)) + self.begin_b[group_a]] = 2 * self.a + last_a
        signs[np.arange(len(self.b)) + (self.begin_a + self.size_a)[group_b]] = self.of.first_b + 2 * self.b + last_b
        data, at = put(signs, self.of.signs)
        tokens = np.concatenate([self.begin_a + self.begin_b, [len(signs)]])[self.first]
        return pa.Array.from_buffers(pa.large_binary(), len(self.first) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[tokens])), pa.py_buffer(np.ascontiguousarray(data))])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, pair (A's id above 32 bits of B's) and how often it is linked there; a pair may come several times. In the order of strings."""
        small = np.flatnonzero(self.links <= WIDE)
        n = self.links[small]
        group, k = np.repeat(small, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        parts = [(group, self.a[self.begin_a[group] + k // self.size_b[group]] << 32 | self.b[self.begin_b[group] + k % self.size_b[group]], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(self.links > WIDE).tolist():
            (a, times_a), (b, times_b) = (np.unique(ids[at : at + size], return_counts=True) for ids, at, size in ((self.a, self.begin_a[g], self.size_a[g]), (self.b, self.begin_b[g], self.size_b[g])))
            parts.append((np.full(len(a) * len(b), g), (a[:, None] << 32 | b[None, :]).ravel(), (times_a[:, None] * times_b[None, :]).ravel()))
        group, pair, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        string = np.searchsorted(self.first, group, side="right") - 1
        if len(parts) > 1:
            order = np.argsort(string, kind="stable")
            string, pair, times = string[order], pair[order], times[order]
        return string, pair, times


def _slices(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where slices of texts, which all begin with a space, begin, with the end behind."""
    begins = np.zeros(len(data) + 1, bool)
    begins[first] = True
    if len(data) > 2:
        ends_seen = _SEEN[data[:-2]]
        ends_seen[1:] |= data[:-3] == LATIN
        begins[1:-2] |= (data[1:-1] == SPACE) & ends_seen & (_SEEN[data[2:]] | (data[2:] == LATIN))
    return np.flatnonzero(begins)


def _odd(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Slices that can't stand beside others: those that begin with more than one blank, end with anything but a visible character, or hold the sign of a blank."""
    a, b = starts[:-1], starts[1:]
    opens = (b - a > 1) & (_SEEN[data[np.minimum(a + 1, b - 1)]] | (data[np.minimum(a + 1, b - 1)] == LATIN))
    closes = _SEEN[data[b - 1]] | ((b - a > 2) & (data[np.maximum(b - 2, 0)] == LATIN))
    odd = ~(opens & closes)
    signs = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
    odd[np.searchsorted(starts, signs, side="right") - 1] = True
    return odd


class Chunk:
    """Texts of a chunk (each with a space before it), aligned."""

    def __init__(self, of: Tokenizers, data: np.ndarray, first: np.ndarray):
        self.n_docs = len(first) - 1
        if not (of.cuts and self._align(of, data, first, _slices(data, first))) and not self._align(of, data, first, first):
            raise AssertionError("a whole text's end is a cut")

    def _align(self, of: Tokenizers, data: np.ndarray, first: np.ndarray, starts: np.ndarray) -> bool:
        numbers, found = distinct(data, starts)
        odd = np.zeros(len(found), bool)
        odd[numbers[_odd(data, starts)]] = True
        even = np.flatnonzero(~odd)
        if len(starts) == len(first):  # whole texts
            even, odd = even[:0], np.ones(len(found), bool)
        sizes = np.array([len(s) for s in found], np.int64)
        of_job = np.cumsum(sizes[even]) // JOB
        jobs = [even[k] for k in np.split(np.arange(len(even)), np.flatnonzero(np.diff(of_job)) + 1) if len(k)] + [np.array([k]) for k in np.flatnonzero(odd)]
        strings = [b"".join([found[k] for k in job]) for job in jobs]
        good, bad = [], np.zeros(len(found), bool)
        for job, string, a, b in zip(jobs, strings, *of.encode(strings), strict=True):
            if of.same(string, a, b):
                good.append((job, a, b))
            elif len(job) == 1:
                bad[job] = True
            else:
                own = [found[k] for k in job]
                for k, s, x, y in zip(job.tolist(), own, *of.encode(own), strict=True):
                    if of.same(s, x, y):
                        good.append((np.array([k]), x, y))
                    else:
                        bad[k] = True
        none = np.empty(0, np.int64)
        order, a, b = (np.concatenate([g[k] for g in good]) if good else none for k in range(3))
        groups = Groups(of, a, b, sizes[order])
        if not groups.whole:
            return False
        # Texts with a bad slice have no tokens; the others' slices by their place among the good ones.
        place = np.full(len(found), -1)
        place[order] = np.arange(len(order))
        doc = np.repeat(np.arange(self.n_docs), np.diff(np.searchsorted(starts, first)))
        spoilt = np.zeros(self.n_docs, bool)
        spoilt[doc[bad[numbers]]] = True
        left = ~spoilt[doc]
        doc, slices = doc[left], place[numbers[left]]
        begin = np.searchsorted(doc, np.arange(self.n_docs + 1))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(groups.counts()[slices], axis=0)]) if len(slices) else np.zeros((1, 4), np.int64)
        self.counts = np.diff(sums[begin], axis=0)
        shown, at = put(slices, groups.shown())
        shown, at = memoryview(np.ascontiguousarray(shown)), at[begin].tolist()
        self.digests = [hashlib.sha256(shown[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]
        self._count(groups, doc, slices)
        return True

    def _count(self, groups: Groups, doc: np.ndarray, slices: np.ndarray) -> None:
        """The distinct pairs, in how many documents each is, and each document's pairs (by number) with how often it has them."""
        string, pair, times = groups.pairs()
        self.pairs, number = np.unique(pair, return_inverse=True)
        span = np.searchsorted(string, np.arange(len(groups.first)))
        n = np.diff(span)[slices] if len(slices) else np.empty(0, np.int64)
        at = np.repeat(span[slices] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(doc, n) * max(1, len(self.pairs)) + number[at]
        order = np.argsort(key)
        key, times = key[order], times[at[order]]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.times = np.add.reduceat(times, new) if len(new) else np.empty(0, np.int64)
        key = key[new]
        self.number = key % max(1, len(self.pairs))
        self.begin = np.searchsorted(key // max(1, len(self.pairs)), np.arange(self.n_docs + 1))
        self.docs = np.bincount(self.number, minlength=len(self.pairs))


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return held((path_a, path_b), lambda: Tokenizers(path_a, path_b))


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in COLUMNS], [name for name, _ in COLUMNS])


def _lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, kind))


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document and one for each distinct pair of a block (those have a pair)."""
    made = [0]

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, part = tokenizers(path_a, path_b), TaskContext.get().partitionId()
        ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_string()).fill_null("")
        filled = pc.greater(pc.binary_length(texts), 0)
        empty = ids.filter(pc.invert(filled))
        if len(empty):
            zero = pa.array(np.zeros(len(empty), np.int64))
            yield _batch(block=pa.array(np.full(len(empty), -1 - part)), doc_id=empty, **dict.fromkeys(COUNTS, zero), groups_sha256=pa.array([""] * len(empty)), at=pa.array([[]] * len(empty), pa.list_(pa.int32())), times=pa.array([[]] * len(empty), pa.list_(pa.int64())))
        ids, at = ids.filter(filled), 0
        for data, first in chunks(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(filled), pa.scalar("", pa.large_string())), BLOCK):
            chunk, n = Chunk(of, data, first), len(first) - 1
            block, made[0] = part << 33 | made[0], made[0] + 1
            counts = {c: pa.array(chunk.counts[:, i]) for i, c in enumerate(COUNTS)}
            yield _batch(block=pa.array(np.full(n, block)), doc_id=ids.slice(at, n), **counts, groups_sha256=pa.array(chunk.digests, pa.string()), at=_lists(chunk.number, chunk.begin, pa.int32()), times=_lists(chunk.times, chunk.begin, pa.int64()))
            m = len(chunk.pairs)
            yield _batch(block=pa.array(np.full(m, block)), pair=pa.array(chunk.pairs), number=pa.array(np.arange(m), pa.int32()), docs=pa.array(chunk.docs, pa.int64()))
            at += n

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, make, SCHEMA)


def _sums(docs: pa.Table, facts: pa.Table) -> pa.Table:
    """docs of a block with n_best and count_sum; facts: number, all (documents of the corpus that have the pair), best."""
    most = (pc.max(facts["number"]).as_py() or 0) + 1 if facts.num_rows else 1
    counts, best = np.zeros(most, np.int64), np.zeros(most, np.int64)
    place = facts["number"].to_numpy()
    counts[place], best[place] = facts["all"].to_numpy(), facts["best"].to_numpy()
    at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
    begin = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy())]).astype(np.int64)
    number, times = pc.list_flatten(at).to_numpy(), pc.list_flatten(times).to_numpy()
    kept = [docs[c] for c in ("doc_id", *COUNTS)]
    for values in (best, counts):
        total = np.concatenate([[0], np.cumsum(values[number] * times)])
        kept.append(pa.array(np.diff(total[begin])))
    return pa.table([*kept, docs["groups_sha256"]], ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs: doc_id long, text string; other columns are ignored. path_a: a byte-level BPE for tokenizers, path_b: a model for sentencepiece.

    Returns for each row doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair is held by as many documents as
    any of its A id's pairs), count_sum (documents that hold the pair, over links) and groups_sha256. A text that is null or
    empty, or whose tokens of either kind don't stand for a space and its bytes, has zeros and an empty digest. Each row is a document, so
    repeated rows count several times and null doc_ids just stay; an empty table gives an empty one.
    """
    found, folder = table(_blocks(docs, path_a, path_b), "alignments")
    pairs = found.where("pair is not null").select("block", "pair", "number", "docs")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("all"), F.count("*").alias("n"))
    a = F.shiftright("pair", 32)
    tops = counts.groupBy(a.alias("a")).agg(F.max("all").alias("top"))
    facts = counts.withColumn("a", a).join(tops, "a").select("pair", "n", "all", (F.col("all") == F.col("top")).cast("int").alias("best"))
    told = join_hot(pairs.drop("docs"), facts, "pair", pairs.count(), by="block", counts=counts).select(F.col("block").alias("of"), "number", "all", "best")
    rows = found.where("pair is null").drop("pair", "number", "docs")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    made, _ = table(rows.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_sums, kinds), "aligned")
    remove_folder(docs.sparkSession, folder)
    return made
