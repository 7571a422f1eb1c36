"""Repeated lines and passages by hashing of normalised units and of picked windows of words.

Every line has a digest of its words, however short it is. Besides, units are lines cut further at sentence ends and before
capitalised words, so that a passage set into the middle of a line has units of its own; long units are cut before words picked by
their hash. A digest covers a stretch of whole units: from every unit on, the shortest stretch of at least `min_words` words, and
up to every unit's end likewise. And windows of
`min_words` words are picked wherever they begin: of every min_words + 1 neighbours the one of lowest digest
(winnowing), so two texts that share a run of 2 * min_words words share a picked window of it. Words are
lower-cased and white space doesn't count. Of each digest the occurrence that comes first by (doc_id,
version, word) stays; all others are cut out of their texts, and their offsets in the original text are kept.

The cut-out runs of stretches and windows are then extended word by word as far as the text goes on like that of the first place. The
outermost picked window of a run of 2 * min_words words lies at most min_words words from either end of it,
so so many words beside the first place, hashed, are all that has to be fetched; only stretches
near the ends of what is cut out ask for them.

Digests are first only counted. What occurs more than once goes into a bit map, by which the second pass leaves out nearly all
others before they are shuffled; ranking then is exact, so a chance hit in the map changes nothing. A map has
BITS_EACH bits for each digest that it holds, at most 2^MOST_MAP_BITS (128 MB); beyond, it lets more through. Hot digests, fewer than
MOST_HOT whatever the input, are known from the count: their occurrences stay together as a row a document and meet their first places,
which are broadcast, so a passage in a third of all documents is neither a single task's work nor a join with a row for each
occurrence. A third pass gives the words beside the first places that are asked for, found by a map like the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import cut, hot_limit, join_hot, map_batches, remove_folder, table

MIN_WORDS, MIN_LINE_WORDS = 25, 1
#: A unit of over min_words words is cut before words whose hash this number divides.
LONG_UNIT_STEP = 8
#: Bits of a map: BITS_EACH for each digest, rounded up to a power of two. They are made in parts of 2^PART_BITS.
BITS_EACH, MOST_MAP_BITS, PART_BITS = 16, 30, 18
#: Texts are taken so many bytes at a time; a longer one is taken by itself.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= n:
        size = max(4096, 2 * n)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        known = _powers[base] = tuple(tables)
    return known


def _digests(words: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Of the words a to b - 1, whatever comes before them."""
    up, down = _power(base, len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    h = (sums[b] - sums[a]) * down[a]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _picked(digest: np.ndarray, n: int) -> np.ndarray:
    """Which digests are the lowest of any n neighbours; equal ones all count. A 0 ends a text: no neighbours go over it."""
    if len(digest) < n:
        return np.zeros(len(digest), bool)

    def slide(row: np.ndarray, of) -> np.ndarray:
        size = 1
        while 2 * size <= n:
            row = of(row[:-size], row[size:])
            size *= 2
        return of(row[: len(row) - n + size], row[n - size :]) if size < n else row

    pad = np.zeros(n - 1, np.uint64)
    return slide(np.concatenate([pad, slide(digest, np.minimum), pad]), np.maximum) == digest


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word."""
    edge = np.diff(np.concatenate([[1], _SPACE[raw].astype(np.int8), [1]]))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in a row, as bytes, a few hundred thousand bytes at a time, and the place of the first."""
    chunk, size, at = [], 0, 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if chunk and size + len(data) > CHUNK:
            yield at, chunk
            chunk, size, at = [], 0, i
        chunk.append(data)
        size += len(data)
    if chunk:
        yield at, chunk


def _word_counts(first: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """How many words of the texts, joined by a byte each, come before each text, and all of them."""
    return np.searchsorted(first, np.append(0, np.cumsum([len(t) + 1 for t in texts])))


def stretches(texts: list[bytes], min_words: int, min_line_words: int = MIN_LINE_WORDS, checks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Of many texts at once, in their order: number of the text, digest, check, first and last word (exclusive) of each line, stretch of units and picked window."""
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    words = data.lower().split()
    if not words:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    first, last = _edges(raw)
    # Words count on over the texts; a text has those from edge[t] up to edge[t + 1].
    edge = _word_counts(first, texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(edge))
    # A word begins a unit after a line's or a sentence's end, or if it begins with A-Z or a capital of U+00C0 to U+00DE.
    lines = np.append(0, np.cumsum(raw == 10, dtype=np.int32))
    lead, second = raw[first], raw[np.minimum(first + 1, len(raw) - 1)]
    begins = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    fresh = np.append(True, lines[first[1:]] > lines[last[:-1]])
    begins[1:] |= _STOP[raw[last[:-1] - 1]]
    begins |= fresh
    h = _hashed(words)
    line = np.flatnonzero(fresh)
    line_end = np.append(line[1:], len(words))
    long_enough = line_end - line >= max(1, min_line_words)
    unit = np.cumsum(begins) - 1
    long = np.bincount(unit) > min_words
    begins |= long[unit] & (h % np.uint64(LONG_UNIT_STEP) == 0)
    bounds = np.append(np.flatnonzero(begins), len(words))
    whose = owner[bounds[:-1]]
    # A text's end is a bound as well.
    to = bounds[np.minimum(np.searchsorted(bounds, bounds[:-1] + min_words), len(bounds) - 1)]
    fits = bounds[:-1] + min_words <= edge[whose + 1]
    back = bounds[np.maximum(np.searchsorted(bounds, bounds[1:] - min_words, side="right") - 1, 0)]
    enough = bounds[1:] - min_words >= edge[whose]
    n = len(words) + 1
    every = np.arange(len(words))
    every = every[every + min_words <= edge[owner + 1]]
    row, slot = np.zeros(len(words) + len(texts), np.uint64), every + owner[every]
    row[slot] = _digests(h, every, every + min_words, _BASE)
    window = every[_picked(row, min_words + 1)[slot]]
    pairs = np.sort(np.concatenate([line[long_enough] * n + line_end[long_enough], bounds[:-1][fits] * n + to[fits], back[enough] * n + bounds[1:][enough], window * n + window + min_words]))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    a, b = pairs // n, pairs % n
    of = owner[a] if len(a) else a
    return of, _digests(h, a, b, _BASE), _digests(h, a, b, _BASE2) if checks else None, a - edge[of], b - edge[of]


def _hits(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    bit = digest >> np.uint64(64 - (len(bits).bit_length() + 2))
    return bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def _marks(doc_id: np.ndarray, version: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (doc_id.astype(np.uint64) * np.uint64(_BASE) + version.view(np.uint64) + start.astype(np.uint64)) * np.uint64(_BASE2)


def _occurrences(docs: DataFrame, min_words: int, min_line_words: int, known=None) -> DataFrame:
    """A row for each line and stretch, its span the first word and, in the low 32 bits, the number of words.

    With `known`, the bit map and the hot digests, only those whose digest is in the map; hot ones are one row a document: digests, checks and spans in `hot`.
    """

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, texts in _chunks(batch.column("text").to_pylist()):
            yield some(batch.slice(at, len(texts)), texts)

    def some(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        of, digest, check, start, end = stretches(texts, min_words, min_line_words, known is not None)
        if known is None:
            return pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64))], ["digest"])
        twice, hot = known.value
        keep = _hits(twice, digest)
        of, digest, check, span = of[keep], digest[keep].view(np.int64), check[keep].view(np.int64), (start << 32 | end - start)[keep]
        often = np.isin(digest, hot, kind="sort") if len(hot) else np.zeros(len(digest), bool)
        owners, begin = np.unique(of[often], return_index=True)
        packed = _binary(np.stack([digest[often], check[often], span[often]], axis=1), begin)
        ids, versions = (batch.column(c).to_numpy() for c in ("doc_id", "version"))
        at, none = np.concatenate([of[~often], owners]), np.zeros(len(owners), np.int64)
        marks = _marks(ids[owners], versions[owners], np.full(len(owners), WHOLE)).view(np.int64)
        columns = [np.concatenate([digest[~often], marks]), np.concatenate([check[~often], none]), ids[at], versions[at], np.concatenate([span[~often], none])]
        packed = pa.concat_arrays([pa.nulls(len(at) - len(owners), pa.binary()), packed])
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], ["digest", "check", "doc_id", "version", "span", "hot"])

    return map_batches(docs, make, "digest long" if known is None else "digest long, check long, doc_id long, version long, span long, hot binary")


def _binary(rows: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of the rows from each begin up to the next."""
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = (np.append(begin, len(rows)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _hot_rows(hots: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """digest, check and span of each occurrence in `hot` columns, and how many each of them holds."""
    each = hots.to_pylist()
    return np.frombuffer(b"".join(each), np.int64).reshape(-1, 3), np.array([len(x) // 24 for x in each], np.int64)


def _hot_firsts(later: DataFrame) -> np.ndarray:
    """digest, check, doc_id, version and span of the first place of each hot digest, in the order of _pair_keys: fewer than MOST_HOT rows, whatever the input."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, n = _hot_rows(batch.column("hot"))
        doc, version = (np.repeat(batch.column(c).to_numpy(), n) for c in ("doc_id", "version"))
        order = np.lexsort((rows[:, 2], version, doc, rows[:, 1], rows[:, 0]))
        pairs = rows[order, :2]
        order = order[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))] if len(order) else order
        return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (rows[:, 0], rows[:, 1], doc, version, rows[:, 2])], ["digest", "check", "doc_id", "version", "span"])

    each = map_batches(later.where("hot is not null").select("doc_id", "version", "hot"), make, "digest long, check long, doc_id long, version long, span long")
    firsts = each.groupBy("digest", "check").agg(F.min(F.struct("doc_id", "version", "span")).alias("first")).select("digest", "check", "first.*").toArrow()
    rows = np.stack([c.to_numpy() for c in firsts.columns], axis=1)
    return rows[np.argsort(_pair_keys(rows))]


def _pair_keys(rows: np.ndarray) -> np.ndarray:
    return rows[:, 0].view() * np.int64(_BASE2 - (1 << 64)) + rows[:, 1]


def _fresh(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where spans, ascending by group and start, neither touch nor overlap what came before them in their group."""
    size = int(end.max()) + 1 if len(end) else 1
    reached = np.maximum.accumulate(group * size + end)
    return np.append(True, group[1:] * size + start[1:] > reached[:-1]) if len(end) else np.empty(0, bool)


def _by_document(later: DataFrame, firsts, min_words: int) -> DataFrame:
    """What is to be cut out of each document, and which words beside first places can add to it.

    Rows at RUNS and at LINES hold first and last word (exclusive) of a document's runs and short lines. Stretches that touch and
    have their first places in one document, equally far off, are one piece of text there as well: only its ends ask for the words
    beside it, and only if they can reach over the end of their run. A row that asks has its own end, 2 * word + side, as `at`, and the
    first place's as `f_at`; side 0 asks for words before it, side 1 for those behind.
    """
    columns = ["span", "f_doc", "f_version", "f_span"]
    grouped = later.groupBy("doc_id", "version").agg(F.collect_list(F.when(F.col("hot").isNull(), F.struct(*columns))).alias("rows"), F.collect_list("hot").alias("hots"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, versions = (batch.column(c).to_numpy() for c in ("doc_id", "version"))
        lists, hots = batch.column("rows"), batch.column("hots")
        of = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        span, f_doc, f_version, f_span = (lists.flatten().field(i).to_numpy() for i in range(len(columns)))
        if firsts is not None:
            rows, n = _hot_rows(hots.flatten())
            owner = np.repeat(np.repeat(np.arange(len(ids)), hots.value_lengths().to_numpy()), n)
            known, keys = firsts.value, _pair_keys(firsts.value)
            to = known[np.minimum(np.searchsorted(keys, _pair_keys(rows)), len(keys) - 1)]
            places = np.stack([ids[owner], versions[owner], rows[:, 2]], axis=1)
            use = (to[:, :2] == rows[:, :2]).all(axis=1) & (to[:, 2:] != places).any(axis=1)
            of = np.concatenate([of, owner[use]])
            span, f_doc, f_version, f_span = (np.concatenate(x) for x in ((span, rows[use, 2]), (f_doc, to[use, 2]), (f_version, to[use, 3]), (f_span, to[use, 4])))
        start, f_start = span >> 32, f_span >> 32
        end = start + (span & 0xFFFFFFFF)
        out = []

        def spans(of: np.ndarray, low: np.ndarray, high: np.ndarray, at: int) -> None:
            owners, begin = np.unique(of, return_index=True)
            none = pa.nulls(len(owners), pa.int64())
            out.append([pa.array(ids[owners]), pa.array(versions[owners]), pa.array(np.full(len(owners), at)), _binary(np.stack([low, high], axis=1).astype(np.int32), begin), none, none, none])

        short = np.flatnonzero(end - start < min_words)
        short = short[np.lexsort((start[short], of[short]))]
        spans(of[short], start[short], end[short], LINES)
        long = np.flatnonzero(end - start >= min_words)
        long = long[np.lexsort((start[long], of[long]))]
        fresh = np.flatnonzero(_fresh(of[long], start[long], end[long]))
        low, high = start[long][fresh], np.maximum.reduceat(end[long], fresh) if len(fresh) else fresh
        spans(of[long][fresh], low, high, RUNS)
        run = np.empty(len(start), np.int64)
        run[long] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(long))))
        far = f_start - start
        long = long[np.lexsort((start[long], far[long], f_version[long], f_doc[long], of[long]))]
        same = np.stack([of[long], f_doc[long], f_version[long], far[long]], axis=1)
        group = np.cumsum(np.append(True, (same[1:] != same[:-1]).any(axis=1))) if len(long) else long
        fresh = np.flatnonzero(_fresh(group, start[long], end[long]))
        first = long[fresh]
        left, right = start[first], np.maximum.reduceat(end[long], fresh) if len(fresh) else fresh
        for side, own, asks in ((0, left, left - min_words < low[run[first]]), (1, right, right + min_words > high[run[first]])):
            who, own = first[asks], own[asks]
            row = ids[of[who]], versions[of[who]], 2 * own + side, None, f_doc[who], f_version[who], 2 * (own + far[who]) + side
            out.append([pa.array(x) if x is not None else pa.nulls(len(who), pa.binary()) for x in row])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["doc_id", "version", "at", "words", "f_doc", "f_version", "f_at"])

    return map_batches(grouped, make, "doc_id long, version long, at long, words binary, f_doc long, f_version long, f_at long")


#: Stands for a whole document among the places of a mark; the rows of a document's runs and short lines.
WHOLE, RUNS, LINES = 1 << 40, -1, -2


def _beside(h: np.ndarray, at: int, most: int) -> bytes:
    """The hashes, cut to 32 bits, of at most so many words before a place (2 * word) or from there on (2 * word + 1), the nearest first."""
    word = at >> 1
    return (h[word : word + most] if at & 1 else h[max(0, word - most) : word][::-1]).astype(np.uint32).tobytes()


def _surroundings(docs: DataFrame, min_words: int, wanted) -> DataFrame:
    """The words beside each place whose two marks are in the bit map `wanted`; only documents whose own mark is in it are looked at."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, versions = (batch.column(c).to_numpy() for c in ("doc_id", "version"))
        columns: list[list] = [[] for _ in range(4)]
        asked = np.flatnonzero(_hits(wanted.value, _marks(ids, versions, np.full(len(ids), WHOLE))))
        for begin, texts in _chunks(batch.column("text").take(pa.array(asked)).to_pylist()):
            data = b"\n".join(texts)
            h = _hashed(data.lower().split())
            edge = _word_counts(_edges(np.frombuffer(data, np.uint8))[0], texts)
            # Each text has two places more than twice its words.
            n = 2 * np.diff(edge) + 2
            of = np.repeat(np.arange(len(texts)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            for shift in (0, 2 * WHOLE):
                who = asked[begin + of]
                hit = _hits(wanted.value, _marks(ids[who], versions[who], at + shift))
                of, at = of[hit], at[hit]
            who = asked[begin + of]
            for column, value in zip(columns, (ids[who], versions[who], at), strict=False):
                column += value.tolist()
            columns[3] += [_beside(h[edge[t] : edge[t + 1]], k, min_words) for t, k in zip(of.tolist(), at.tolist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["f_doc", "f_version", "f_at", "words"])

    return map_batches(docs, make, "f_doc long, f_version long, f_at long, words binary")


def _bit_map(digests: DataFrame, n: int) -> np.ndarray:
    """The highest bits of n digests as a map, in bytes. Its parts are made by the workers; the driver gets no more than the map itself."""
    bits = min(MOST_MAP_BITS, max(PART_BITS, (BITS_EACH * n).bit_length()))

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        marked = np.zeros(1 << PART_BITS, bool)
        marked[rows["bit"].to_numpy() & ((1 << PART_BITS) - 1)] = True
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bytes": [np.packbits(marked, bitorder="little").tobytes()]})

    rows = digests.select(F.expr(f"shiftrightunsigned(digest, {64 - bits})").alias("bit")).withColumn("part", F.shiftright("bit", PART_BITS))
    made = rows.groupBy("part").applyInPandas(part, "part long, bytes binary").toArrow()
    out = np.zeros((1 << (bits - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    for k, data in zip(made["part"].to_pylist(), made["bytes"].to_pylist(), strict=True):
        out[k] = np.frombuffer(data, np.uint8)
    return out.ravel()


def _marked(asked: DataFrame) -> DataFrame:
    """Two marks of each first place and one of its document, as digests for a bit map."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, version, at = (batch.column(c).to_numpy() for c in ("f_doc", "f_version", "f_at"))
        mark = np.concatenate([_marks(doc, version, x) for x in (at, at + 2 * WHOLE, np.full(len(doc), WHOLE))])
        return pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64))], ["digest"])

    return map_batches(asked.select("f_doc", "f_version", "f_at"), make, "digest long")


def _extended(h: np.ndarray, at: int, beside: bytes, most: int) -> tuple[int, int]:
    """First and last word (exclusive) of what goes on from a place like the words beside its first place."""
    x, y = np.frombuffer(_beside(h, at, most), np.uint32), np.frombuffer(beside, np.uint32)
    size = min(len(x), len(y))
    other = np.flatnonzero(x[:size] != y[:size])
    n, word = int(other[0]) if len(other) else size, at >> 1
    return (word, word + n) if at & 1 else (word - n, word)


def _union(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans, ascending; those with nothing but white space between them become one."""
    union: list[list[int]] = []
    for a, b in sorted(spans):
        if union and (a <= union[-1][1] or not data[union[-1][1] : a].strip()):
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    return [(a, b) for a, b in union]


def _offsets(data: bytes, union: list[tuple[int, int]]) -> list[dict]:
    """Byte spans as character offsets."""
    if not union:
        return []
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[a]), "end": int(chars[b])} for a, b in union]


def _without(data: bytes, union: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in union:
        kept.append(data[at:a])
        rest = data[b:]
        at = b + len(rest) - len(rest.lstrip(b" \t\r\n\x0b\x0c"))
        if data[b:at].count(b"\n") and a and data[a - 1 : a] == b" ":
            kept.append(b"\n")
    kept.append(data[at:])
    out = b"".join(kept)
    return (out if data[-1:].isspace() else out.rstrip()).decode("utf-8", "surrogatepass")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (t.lower() for t in taken):
        name += "_"
    return name


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """docs: doc_id long, text string, any other columns; those named removed or removed_lines are replaced.

    Returns docs, each row once, with `text` less its repeated lines and passages, and the cut-out
    spans as arrays of (start, end) character offsets in the original text, ascending: `removed` has passages, `removed_lines` the
    lines of at least min_line_words and fewer than min_words words outside of these. A text without repeats is returned as it is.

    A line that repeats as a whole is found whatever its length (min_line_words is 1 unless said otherwise; from min_words on, no
    short line is looked for). A run of 2 * min_words words that repeats is found wherever it begins, and so are shorter ones, of
    min_words words or more, of whole units. Extension follows the first place of each stretch.

    Null text stays null; lines without words don't count. Rows with a null
    doc_id have no rank: they neither lose nor claim anything. Rows that share doc_id and text count as one
    document; rows that share just a doc_id rank by their text's hash. What a document holds twice
    keeps its first place. A document may be left with an empty text. An empty table gives an empty one.
    """
    docs = docs.drop("removed", "removed_lines")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    keyed = keyed.where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    counted = cut(_occurrences(keyed, min_words, min_line_words).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    n_digests, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = np.sort(counted.where(F.col("n") > hot_limit(total)).select("digest").toArrow()["digest"].to_numpy())
    known = spark.sparkContext.broadcast((_bit_map(counted, n_digests), hot))
    # Only digests that aren't hot are ranked here, so no window holds more than hot_limit rows; hot ones come as a row a document.
    place = F.struct("doc_id", "version", "span")
    first = F.first(place).over(Window.partitionBy("digest", "check").orderBy("doc_id", "version", "span"))
    later = _occurrences(keyed, min_words, min_line_words, known).withColumn("first", first).where((place != F.col("first")) | F.col("hot").isNotNull())
    later, folder = table(later.select("doc_id", "version", "span", F.col("first.doc_id").alias("f_doc"), F.col("first.version").alias("f_version"), F.col("first.span").alias("f_span"), "hot"), "later")
    firsts = spark.sparkContext.broadcast(_hot_firsts(later)) if len(hot) else None
    found, _ = table(_by_document(later, firsts, min_words), "found")
    remove_folder(spark, folder)
    asks, at = found.where("f_doc is not null").drop("words"), ["f_doc", "f_version", "f_at"]
    asked = cut(asks.groupBy(*at).agg(F.count("*").alias("n")), large=False)
    n_asked, n_asks = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = spark.sparkContext.broadcast(_bit_map(_marked(asked), 3 * n_asked))
    beside = asked.join(_surroundings(keyed, min_words, wanted).dropDuplicates(at), at)
    near = join_hot(asks, beside, at, n_asks, "version", "inner", asked)
    columns = "doc_id", "version", "at", "words"
    spans = found.where("f_doc is null").select(*columns).unionByName(near.select(*columns))
    names = docs.columns
    own, spans_name = _free("__version", names), _free("__spans", names)
    spans = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "words")).alias(spans_name))

    left = docs.withColumn(own, F.xxhash64(F.col("text").cast("string"))).alias("d")
    joined = left.join(spans.alias("s"), (F.col("d.doc_id") == F.col("s.doc_id")) & (F.col(f"d.`{own}`") == F.col("s.version")), "left")
    joined = joined.select(*(F.col(f"d.`{c}`") for c in names), F.col(f"s.`{spans_name}`"))
    at = [n.lower() for n in names].index("text")
    kind = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = T.StructType([*docs.schema.fields]).add("removed", kind).add("removed_lines", kind)

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, removed, removed_lines = batch.column(at).to_pylist(), [], []
        lists = batch.column(len(names))
        spots, words = (lists.flatten().field(i).to_pylist() for i in range(2))
        bounds = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())).tolist()
        for i, text in enumerate(texts):
            passages, lines, data = [], [], b""
            spans = dict.fromkeys(zip(spots[bounds[i] : bounds[i + 1]], words[bounds[i] : bounds[i + 1]], strict=True))
            if spans and text is not None:
                data = text.encode("utf-8", "surrogatepass")
                first, last = _edges(np.frombuffer(data, np.uint8))
                pairs = {kind: [tuple(p) for where, x in spans if where == kind for p in np.frombuffer(x, np.int32).reshape(-1, 2).tolist()] for kind in (RUNS, LINES)}
                asks = [s for s in spans if s[0] >= 0]
                h = _hashed(data.lower().split()) if asks else None
                runs = {*pairs[RUNS], *(_extended(h, where, x, min_words) for where, x in asks)}
                passages = _union(data, [(int(first[a]), int(last[b - 1])) for a, b in runs if a < b])
                lines = [(int(first[a]), int(last[b - 1])) for a, b in pairs[LINES]]
                lines = _union(data, [(a, b) for a, b in lines if not any(c <= a and b <= d for c, d in passages)])
                texts[i] = _without(data, _union(data, passages + lines))
            removed.append(_offsets(data, passages))
            removed_lines.append(_offsets(data, lines))
        columns = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind), pa.array(removed_lines, kind)], [*names, "removed", "removed_lines"])

    return map_batches(joined, apply, schema)
