"""GIF media columns: decoding of LZW streams, palettes, disposal and transparency, and a lossless payload form.

`decode` reads any GIF87a or GIF89a image, `render` composes its timed frames, `media_columns` makes
table columns of them. `encode_payload` stores bytes as the palette indices of frames 64 pixels wide,
under a grey palette whose entry i is (i, i, i), in code streams whose table grows with every code; a frame is small enough for its
table not to fill up. Many frames are coded in step, a byte of each at a time: their tables are rows of one array, in which a pair
of code and byte has one place. A place that another pair holds makes the encoder miss an entry, which only makes the stream longer.

Reading a code stream is array work. The width of a code follows from its place since the last clear code, so
all codes up to the next one are taken out at once. The entry that a code adds is what the code wrote and one
byte more, so every entry is a stretch of the output itself: a code's length is its depth in the tree of entries, and each byte
it writes points to an earlier place. Both are found by following all pointers in steps that double.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import map_batches, texts_of

WIDTH, ROWS_A_FRAME, UNIT = 64, 59, 64
#: Fixed values of the format: the widest codes, and how many codes fill a table at most.
MOST_BITS, MOST_CODES = 12, 4096
#: So many codes of eight bits can't fill a table. Frames that are coded in step; places in a frame's table; a factor that spreads pairs.
MOST_LITERALS, STREAMS, PLACES, MIX = MOST_CODES - 258, 1024, 2048, 0x9E3779B1
#: Streams that are read side by side.
AT_ONCE = 64
DELAY_CS = 10
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
BINS = 16


class BadGif(ValueError):
    pass


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_cs: int
    disposal: int
    transparent: int | None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]


def _widths(least_bits: int) -> np.ndarray:
    """The width of the code at each place since a clear code, up to where it stays at MOST_BITS."""
    known = (1 << least_bits) + 2 + np.maximum(0, np.arange(MOST_CODES) - 1)
    return np.minimum(MOST_BITS, np.maximum(least_bits + 1, np.floor(np.log2(known)).astype(np.int64) + 1))


def lzw_encode(parts: list[bytes]) -> list[bytes]:
    """The code streams, of least eight bits, of byte strings of at most MOST_LITERALS bytes. Each code adds an entry."""
    order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
    out = [b""] * len(parts)
    for at in range(0, len(order), STREAMS):
        some = order[at : at + STREAMS]
        for k, data in zip(some, _in_step([parts[k] for k in some]), strict=True):
            out[k] = data
    return out


def _in_step(parts: list[bytes]) -> list[bytes]:
    """lzw_encode of byte strings in descending order of length."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    if sizes[0] > MOST_LITERALS:
        raise ValueError(f"a frame has at most {MOST_LITERALS} bytes")
    steps, clear = int(sizes[0]), 256
    columns = np.zeros((len(parts), steps), np.uint8)
    columns[np.arange(steps) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    columns = np.ascontiguousarray(columns.T).astype(np.int64)
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    # A place holds the pair (code << 8 | byte) above twelve bits of the entry's code; at first one that no frame gets to.
    table = np.full(len(parts) * PLACES, 0xFFFFFFFF, np.uint32)
    row = np.arange(len(parts)) * PLACES
    codes = np.empty((len(parts), steps + 3), np.int64)
    codes[:, 0], count = clear, np.ones(len(parts), np.int64)
    flat, first, last = codes.reshape(-1), np.arange(len(parts)) * codes.shape[1], columns[0].copy() if steps else np.zeros(0, np.int64)
    for t in range(1, steps):
        n = active[t]
        byte = columns[t, :n]
        pair = last[:n] << 8 | byte
        place = (pair * MIX >> 20 & PLACES - 1) + row[:n]
        found = table.take(place)
        other = found >> MOST_BITS != pair
        miss = np.flatnonzero(other)
        ended = count[miss]
        flat[first[miss] + ended] = last[miss]
        count[miss] = ended + 1
        # The first code after the clear code adds the table's first entry.
        table[place[miss]] = pair[miss] << MOST_BITS | clear + 1 + ended
        np.copyto(last[:n], found & (1 << MOST_BITS) - 1, casting="unsafe")
        last[miss] = byte[miss]
    some = np.flatnonzero(sizes > 0)
    flat[first[some] + count[some]] = last[some]
    count[some] += 1
    flat[first + count] = clear + 1
    count += 1
    values = codes[np.arange(codes.shape[1]) < count[:, None]]
    since = np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count) - 1
    width = _WIDTHS[8][np.maximum(0, since)]
    ends = np.cumsum(width)
    bits = ends[np.cumsum(count) - 1]
    bits = np.diff(bits, prepend=0)
    whole = (bits + 7) >> 3
    begin = np.cumsum(whole) - whole
    offset = ends - width - np.repeat(np.cumsum(bits) - bits, count)
    at, shifted, total = np.repeat(begin, count) + (offset >> 3), values << (offset & 7), int(whole.sum())
    data = sum(np.bincount(at + k, shifted >> 8 * k & 0xFF, total + 2) for k in range(3)).astype(np.uint8).tobytes()
    return [data[a : a + n] for a, n in zip(begin.tolist(), whole.tolist(), strict=True)]


_WIDTHS = {bits: _widths(bits) for bits in range(1, 12)}
#: By place since a clear code, how far above the clear code a code may be.
_LIMITS = {bits: np.concatenate([[-1], np.minimum(1 + np.arange(1, MOST_CODES), (1 << MOST_BITS) - 1 - (1 << bits))]) for bits in _WIDTHS}
_MASKS = ((1 << np.arange(MOST_BITS + 1)) - 1).astype(np.uint32)
_OFFSETS = {bits: np.concatenate([np.zeros(1, np.int64), np.cumsum(w)]) for bits, w in _WIDTHS.items()}


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255 * 255
    rows = np.frombuffer(data[:whole], np.uint8).reshape(-1, 255)
    first = np.hstack([np.full((len(rows), 1), 255, np.uint8), rows]).tobytes()
    rest = data[whole:]
    return first + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """GIFs whose frames' indices are the payloads, whose lengths are positive multiples of UNIT."""
    if any(not p or len(p) % UNIT for p in payloads):
        raise ValueError("a payload must be a positive multiple of 64 bytes")
    size = WIDTH * ROWS_A_FRAME
    parts = [[p[at : at + size] for at in range(0, len(p), size)] for p in payloads]
    streams, out = iter(lzw_encode([part for own in parts for part in own])), []
    for own in parts:
        image = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(ROWS_A_FRAME, len(own[0]) // WIDTH), 0xF7, 0, 0), GREY.tobytes()]
        for part in own:
            image += [b"\x21\xf9\x04", struct.pack("<BHB", 0x04, DELAY_CS, 0), b"\0\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(next(streams))]
        out.append(b"".join(image) + b"\x3b")
    return out


@dataclass
class Stream:
    """A code stream: its data, least bits, and how many indices are wanted."""

    data: bytes
    least_bits: int
    n: int


def lzw_decode(streams: list[Stream]) -> list[np.ndarray]:
    """The first n indices of every code stream; one that ends early or breaks off gives fewer."""
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for bits in {x.least_bits for x in streams if 1 <= x.least_bits < MOST_BITS}:
        some = [k for k, x in enumerate(streams) if x.least_bits == bits and x.n > 0]
        for at in range(0, len(some), AT_ONCE):
            _read(streams, some[at : at + AT_ONCE], bits, out)
    return [np.concatenate(parts) if parts else np.empty(0, np.uint8) for parts in out]


def _read(streams: list[Stream], some: list[int], least_bits: int, out: list[list[np.ndarray]]) -> None:
    """Read what some streams write up to their next clear codes, again and again; all have the same least bits."""
    clear, offsets, widths, limits = 1 << least_bits, _OFFSETS[least_bits], _WIDTHS[least_bits], _LIMITS[least_bits]
    joined = b"".join([streams[k].data for k in some]) + bytes(4)
    window = np.ndarray((len(joined) - 3,), "<u4", joined, 0, (1,))  # the four bytes from every byte on
    sizes = np.fromiter((len(streams[k].data) for k in some), np.int64, len(some))
    base, bits = np.cumsum(sizes) - sizes, 8 * sizes
    wanted = np.fromiter((streams[k].n for k in some), np.int64, len(some))
    at, pending = np.zeros(len(some), np.int64), np.arange(len(some))
    # Codes since the last clear code of a stream whose full table isn't cleared, and so goes on with the widest codes.
    held: dict[int, np.ndarray] = {}
    while len(pending):
        had = np.array([len(held[k]) if k in held else 0 for k in pending.tolist()]) if held else np.zeros(len(pending), np.int64)
        # No more codes than bits are left for, each of at least least_bits + 1.
        most = np.minimum(np.minimum(MOST_CODES, wanted[pending] - had + 1), (bits - at)[pending] // (least_bits + 1) + 1)
        starts = np.cumsum(most) - most
        of = np.repeat(np.arange(len(pending)), most)
        since = np.arange(len(of)) - np.repeat(starts, most)
        offset, width, limit = offsets[since], widths[since], limits[since]
        if held:
            again = (had > 0)[of]
            offset, width, limit = np.where(again, MOST_BITS * since, offset), np.where(again, MOST_BITS, width), np.where(again, limits[-1], limit)
        offset = offset + np.repeat(at[pending], most)
        fits = offset + width <= np.repeat(bits[pending], most)
        byte = np.repeat(base[pending], most) + np.where(fits, offset >> 3, 0)
        above = ((window[byte] >> (offset & 7).astype(np.uint32)) & _MASKS[width]).astype(np.int64) - clear
        wrong = above > limit
        wrong |= above >> 1 == 0
        wrong |= ~fits
        stop = np.minimum.reduceat(np.where(wrong, since, MOST_CODES), starts)
        stop = np.minimum(stop, most)
        keep = since < stop[of]
        codes, own = above[keep] + clear, of[keep]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(stop)])
        last = starts + np.minimum(stop, most - 1)
        cleared = (stop < most) & fits[last] & (above[last] == 0)
        following, full = offset[last] + width[last], stop == most
        if (had > 0).any() or full.any():
            parts, ready = [], []
            for k, i in enumerate(pending.tolist()):
                part = codes[ends[k] : ends[k + 1]]
                part = np.concatenate([held.pop(i), part]) if i in held else part
                if full[k] and len(part) < wanted[i]:
                    held[i] = part
                else:
                    parts.append(part)
                    ready.append(k)
            ready = np.array(ready, np.int64)
            codes, stop = (np.concatenate(parts) if parts else codes[:0]), np.array([len(p) for p in parts], np.int64)
            own = np.repeat(np.arange(len(ready)), stop)
        else:
            ready = np.arange(len(pending))
        written, made = _stretch(codes, own, stop, clear)
        at[pending] = following
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(made)]).tolist()
        for k, i in enumerate(pending[ready].tolist()):
            if made[k]:
                out[some[i]].append(written[cuts[k] : cuts[k + 1]][: wanted[i]])
                wanted[i] = max(0, wanted[i] - made[k])
        go_on = np.zeros(len(pending), bool)
        go_on[ready] = cleared[ready] & (wanted[pending[ready]] > 0)
        go_on |= np.array([i in held for i in pending.tolist()], bool)
        pending = pending[go_on]


def _stretch(codes: np.ndarray, of: np.ndarray, n_codes: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray]:
    """What the codes of several streams since their clear codes write, end to end, and how much each stream does. All codes are bytes or entries that are known by then."""
    begin = np.cumsum(n_codes) - n_codes
    entry = codes > clear
    up = np.where(entry, begin[of] + codes - clear - 2, np.arange(len(codes)))
    depth, above = entry.astype(np.int64), up
    while (more := depth[above]).any():
        depth, above = depth + more, above[above]
    sizes = depth + 1
    first = np.cumsum(sizes) - sizes
    source = np.arange(int(sizes.sum())) + np.repeat(first[up] - first, sizes)
    while not np.array_equal(earlier := source[source], source):
        source = earlier
    written = np.zeros(len(source), np.uint8)
    written[first[~entry]] = codes[~entry]
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    return written[source], total[begin + n_codes] - total[begin]


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(rows), 0
    for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(first, len(rows), step))
        out[first::step] = rows[at : at + n]
        at += n
    return out


def _parse(data: bytes) -> tuple[Gif, list[tuple[Stream, bool]]]:
    """The frames, without indices, and each one's code stream and whether it is interlaced. Raises BadGif if the structure is broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, GREY
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    gif, streams = Gif(width, height, []), []
    delay, disposal, transparent = 0, 0, None

    def chain(at: int) -> tuple[bytes, int]:
        parts = []
        while (n := data[at]) != 0:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                body, after = chain(at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    f, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = f >> 2 & 7, index if f & 1 else None
                at = after
            elif data[at] == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                at, own = at + 10, palette
                if flags & 0x80:
                    n = 2 << (flags & 7)
                    own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                    at += 3 * n
                body, after = chain(at + 1)
                streams.append((Stream(body, data[at], w * h), bool(flags & 0x40)))
                gif.frames.append(Frame(left, top, np.zeros((h, w), np.uint8), own, delay, disposal, transparent))
                at, delay, disposal, transparent = after, 0, 0, None
            else:
                raise BadGif(f"unknown block {data[at]:#x}")
    except (IndexError, struct.error, ValueError) as e:
        raise BadGif(f"broken off: {e}") from e
    return gif, streams


def decode_many(images: list[bytes | None]) -> list[Gif | BadGif]:
    """Frames with their raw indices; missing indices count as 0. An image of broken structure gives the error."""
    out: list[Gif | BadGif] = []
    streams: list[tuple[Frame, Stream, bool]] = []
    for data in images:
        try:
            if data is None:
                raise BadGif("null")
            gif, own = _parse(data)
            streams += [(frame, *x) for frame, x in zip(gif.frames, own, strict=True)]
            out.append(gif)
        except BadGif as e:
            out.append(e)
    for (frame, _, interlaced), got in zip(streams, lzw_decode([x for _, x, _ in streams]), strict=True):
        shape = frame.indices.shape
        if len(got) < shape[0] * shape[1]:
            got = np.concatenate([got, np.zeros(shape[0] * shape[1] - len(got), np.uint8)])
        frame.indices = _deinterlaced(got.reshape(shape)) if interlaced else got.reshape(shape)
    return out


def decode(data: bytes) -> Gif:
    """decode_many for one image. Raises BadGif if the structure is broken."""
    (made,) = decode_many([data])
    if isinstance(made, BadGif):
        raise made
    return made


def render(gif: Gif) -> Iterator[tuple[np.ndarray, int]]:
    """Each frame as shown: RGBA pixels of the canvas and its delay in hundredths of a second. The pixels hold until the next frame is asked for."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    cells = canvas.view(np.uint32)[..., 0]
    for f in gif.frames:
        h, w = max(0, min(f.indices.shape[0], gif.height - f.top)), max(0, min(f.indices.shape[1], gif.width - f.left))
        part = f.indices[:h, :w]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3], colours[:, 3] = f.palette, 255
        if f.transparent is not None:
            colours[f.transparent] = 0
        view = cells[f.top : f.top + h, f.left : f.left + w]
        before = view.copy() if f.disposal == 3 else None
        shown = colours.view(np.uint32)[:, 0][part]
        view[:] = shown if f.transparent is None else np.where(part == f.transparent, view, shown)
        yield canvas, f.delay_cs
        if f.disposal == 2:
            view[:] = 0
        elif f.disposal == 3:
            view[:] = before


def histogram(pixels: np.ndarray, bins: int = BINS) -> list[int]:
    """Counts of the opaque pixels by red, then green, then blue in `bins` equal ranges each."""
    flat = pixels.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    by_value = (np.bincount(flat[:, c], minlength=256) for c in range(3))
    return [int(n) for counts in by_value for n in np.bincount(np.arange(256) * bins // 256, counts, bins)]


def media_columns(images: DataFrame) -> DataFrame:
    """images: id long, gif binary; other columns are ignored.

    Returns id, width, height, n_frames, frames (array of start_ms, duration_ms, rgba and histogram) and
    error. A null or broken image has null columns and says why in error; repeated rows stay.
    """
    shape = "id long, width int, height int, n_frames int, frames array<struct<start_ms:long,duration_ms:long,rgba:binary,histogram:array<long>>>, error string"
    kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("duration_ms", pa.int64()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64()))]))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for gif in decode_many(batch.column("gif").to_pylist()):
            if isinstance(gif, BadGif):
                rows.append((None, None, None, None, str(gif)))
                continue
            start, frames = 0, []
            for pixels, delay in render(gif):
                frames.append({"start_ms": start, "duration_ms": delay * 10, "rgba": pixels.tobytes(), "histogram": histogram(pixels)})
                start += delay * 10
            rows.append((gif.width, gif.height, len(frames), frames, None))
        types = [pa.int32(), pa.int32(), pa.int32(), kind, pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["id", "width", "height", "n_frames", "frames", "error"])

    return map_batches(images.select(F.col("id").cast("long").alias("id"), F.col("gif").cast("binary").alias("gif")), make, shape)


def padded(text: str) -> tuple[bytes, int]:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT)), len(data)


def text_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """docs: doc_id long, text string; other columns are ignored. Null text counts as empty.

    Each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are stored as a GIF and read
    back by the decoder; the feature comes from its rendered frames. Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (frames, time shown and the colour histogram over all frames), and with_media the GIF. All
    but n_bytes, media_bytes and media_sha256 come from the stored form. Equal texts have equal values;
    repeated rows and null doc_ids stay; an empty table gives an empty one.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, media = [], []
        payloads = [padded(text) for text in texts_of(batch)]
        images = encode_payloads([payload for payload, _ in payloads])
        for stored, gif, (_, n) in zip(images, decode_many(images), payloads, strict=True):
            back = b"".join([f.indices.tobytes() for f in gif.frames])
            shown = [(histogram(pixels), delay) for pixels, delay in render(gif)]
            counts = np.sum([h for h, _ in shown], axis=0)
            feature = f"frames={len(shown)};ms={sum(d for _, d in shown) * 10};rgb={','.join(map(str, counts.tolist()))}"
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            media.append(stored if with_media else None)
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))]
        if with_media:
            columns, names = [*columns, pa.array(media, pa.binary())], [*names, "media"]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, make, schema)
