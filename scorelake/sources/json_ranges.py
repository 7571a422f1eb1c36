"""Large JSON files in parallel: byte ranges are scanned by themselves and joined by what each does to the parser's state.

Spark's text reader cuts files at commas, in byte ranges of its own, so a range is whole segments between commas. What a range does to the
state (inside a string, depth) is a transition: the number of its quotes, and the change of depth for either
state at its beginning. Transitions are associative; prefix sums of them over a file's ranges give each range's state at its beginning.
With that state every range cuts its records by itself, at commas of the wanted depth. A record that goes over a range's end is written in
parts, which are put together by a sum over ranges; no task reads more than its ranges, and no row holds more than a record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import scratch_folder, share_code

QUOTE, ESCAPE = 34, 92
_DELTA = np.zeros(256, np.int64)
_DELTA[[ord("["), ord("{")]] = 1
_DELTA[[ord("]"), ord("}")]] = -1
BLANKS = b" \t\n\r"
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)
#: A record's place: its range, its number there (one that goes on in the next range comes behind the others), and its values (one, unless it is broken).
RANGE_BITS, VALUE_BITS, SPANNING = 42, 16, 1 << 25
TRANSITIONS = "file long, block long, quotes long, outside long, inside long, lead int, opens boolean, quotes_after long, depth_after long, bytes long, last int"
PIECES = "file long, range long, kind int, number long, text binary, section string, closed boolean, extra boolean"
WHOLE, BEGIN, MORE, FACTS = range(4)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), block (where its range begins) and value, the bytes between two commas; in the order of the file within a block."""
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, path and size."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """Segments of one range after another; a range may come in several parts."""
    for batch in batches:
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        rows = batch.column("value").to_pylist()
        ends = np.r_[np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1, len(rows)].tolist()
        at = 0
        for end in ends if rows else ():
            yield (int(file[at]), int(block[at])), rows[at:end]
            at = end


class Signs:
    """Quotes and brackets of segments, which lie end to end."""

    def __init__(self, rows: list[bytes]):
        data = np.frombuffer(b"".join(rows), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        quotes = np.flatnonzero(data == QUOTE)
        escapes = data == ESCAPE
        if escapes.any() and len(quotes):
            # The last byte before each that is no backslash: an odd number between takes a quote's meaning.
            other = np.maximum.accumulate(np.where(escapes, -1, np.arange(len(data))))
            before = np.where(quotes > 0, other[np.maximum(quotes - 1, 0)], quotes - 1)
            quotes = quotes[(quotes - 1 - before) % 2 == 0]
        self.quotes, self.places = quotes, np.flatnonzero(_DELTA[data])
        self.deltas = _DELTA[data[self.places]]
        self.odd = np.searchsorted(quotes, self.places) % 2 == 1

    def seen(self, inside: bool) -> np.ndarray:
        """Which brackets stand outside strings if the first segment begins inside one or not."""
        return self.odd == inside


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, now = [], None
    for key, rows in _runs(batches):
        if now is None or now[0] != key:
            now = [key, 0, 0, 0, -1, False, 0, 0, 0, -1]
            made.append(now)
        signs = Signs(rows)
        now[8] += int(signs.ends[-1]) + len(rows)
        now[9] = next((x[-1] for x in (row.rstrip(BLANKS) for row in reversed(rows)) if x), now[9])
        if now[5]:
            now[7] += int(signs.deltas[signs.seen(now[6] % 2 == 1)].sum())
            now[6] += len(signs.quotes)
        else:
            k = next((k for k, row in enumerate(rows) if b"[" in row), -1)
            if k >= 0:
                after = Signs([rows[k][rows[k].index(b"[") :], *rows[k + 1 :]])
                now[5:8] = [True, len(after.quotes), int(after.deltas[after.seen(False)].sum())]
        flips = now[1] % 2 == 1
        now[2] += int(signs.deltas[signs.seen(flips)].sum())
        now[3] += int(signs.deltas[signs.seen(not flips)].sum())
        now[1] += len(signs.quotes)
        if now[4] < 0:
            now[4] = next((x[0] for x in (row.lstrip(BLANKS) for row in rows) if x), -1)
    columns = [[m[0][0] for m in made], [m[0][1] for m in made], *([m[k] for m in made] for k in range(1, 10))]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in TRANSITIONS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def states(spark: SparkSession, path: str) -> DataFrame:
    """For each range its number in the file, the file's first sign (`top`), and the state at the range's beginning: seen from the file's
    beginning (inside, depth, begun) and, for what is left of a broken file, from its first `[` (salvage_*).
    """
    share_code(spark)
    found = segments(spark, path).mapInArrow(_transitions, TRANSITIONS)
    before = "over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    found = found.selectExpr(
        "*", "row_number() over (partition by file order by block) - 1 as range", f"coalesce(sum(quotes) {before}, 0) % 2 = 1 as inside_before",
        f"first(if(lead >= 0, lead, null), true) over (partition by file order by block rows between unbounded preceding and unbounded following) as top", f"coalesce(max(lead >= 0) {before}, false) as begun",
        f"coalesce(max(opens) {before}, false) as salvage_begun",
    )
    # From the first `[` on: that range counts what is behind the sign, the ones after it all they have.
    found = found.selectExpr("*", "if(salvage_begun, quotes, if(opens, quotes_after, 0)) as own_quotes").selectExpr("*", f"coalesce(sum(own_quotes) {before}, 0) % 2 = 1 as salvage_inside")
    found = found.selectExpr("*", "if(inside_before, inside, outside) as change", "if(salvage_begun, if(salvage_inside, inside, outside), if(opens, depth_after, 0)) as salvage_change")
    return found.selectExpr(
        "file", "block", "range", "top", "inside_before as inside", f"coalesce(sum(change) {before}, 0) as depth", "begun", "opens", "salvage_begun", "salvage_inside", f"coalesce(sum(salvage_change) {before}, 0) as salvage_depth", "quotes", "bytes", "last"
    )


@dataclass
class Cutter:
    """Cuts the records of one range, whose segments come in parts. depth: brackets around a record."""

    range: int
    depth: int
    inside: bool
    level: int
    open: bool
    closed: bool
    skips: bool = False
    #: Whether the record at hand began in an earlier range, its segments so far, and what stands before a list (its name).
    spans: bool = False
    parts: list[bytes] = field(default_factory=list)
    head: list[bytes] = field(default_factory=list)
    section: str | None = None
    extra: bool = False
    number: int = 0
    made: list[tuple] = field(default_factory=list)

    def emit(self, kind: int, text: bytes) -> None:
        self.made.append((self.range, kind, self.number, text, self.section, None, None))
        self.number += 1

    def end_record(self, last: bytes) -> None:
        self.emit(MORE if self.spans else WHOLE, b",".join([*self.parts, last]))
        self.parts, self.spans = [], False

    def feed(self, rows: list[bytes]) -> None:
        if self.skips:
            k = next((k for k, row in enumerate(rows) if b"[" in row), len(rows))
            rows = rows[k:]
            if not rows:
                return
            rows[0], self.skips = rows[0][rows[0].index(b"[") :], False
        signs = Signs(rows)
        seen = signs.seen(self.inside)
        places, deltas = signs.places[seen], signs.deltas[seen]
        levels = self.level + np.cumsum(deltas)
        upto = np.r_[self.level, levels][np.searchsorted(places, signs.ends)]
        inside = (np.searchsorted(signs.quotes, signs.ends) + self.inside) % 2 == 1
        cuts = ~inside & (upto == self.depth)
        events = np.flatnonzero((deltas > 0) & (levels == self.depth) | (deltas < 0) & (levels == self.depth - 1))
        of = np.searchsorted(signs.ends, places[events], side="right")
        begins = signs.ends - np.fromiter(map(len, rows), np.int64, len(rows))
        at: dict[int, list[tuple[int, int]]] = {}
        for e, k in zip(events.tolist(), of.tolist(), strict=True):
            at.setdefault(k, []).append((int(places[e] - begins[k]), int(deltas[e])))
        done = 0
        for k in sorted({*np.flatnonzero(cuts).tolist(), *at}):
            self._pass(rows[done:k])
            self._row(rows[k], at.get(k, []), bool(cuts[k]))
            done = k + 1
        self._pass(rows[done:])
        self.inside, self.level = bool(inside[-1]), int(upto[-1])

    def _pass(self, rows: list[bytes]) -> None:
        """Segments in which no record begins or ends."""
        if self.open:
            self.parts += rows
        elif self.closed and self.depth == 1:
            self.extra |= bool(rows)
        else:
            self.head += rows

    def _row(self, row: bytes, events: list[tuple[int, int]], cut: bool) -> None:
        start = 0
        if self.closed and self.depth == 1:
            self.extra = True
            return
        for place, delta in events:
            if delta > 0 and not self.open:
                name = _KEY.search(b",".join([*self.head, row[start:place]]))
                self.section = json.loads(b'"' + name[1] + b'"') if name and row[place : place + 1] == b"[" else None if self.depth == 1 else ""
                self.open, self.head, start = True, [], place + 1
            elif delta < 0 and self.open:
                self.end_record(row[start:place])
                self.open, self.closed, start = False, True, place + 1
                if self.depth == 1:
                    self.extra |= bool(row[start:].strip(BLANKS))
                    return
        if self.open and cut:
            self.end_record(row[start:])
        elif self.open:
            self.parts.append(row[start:])
        else:
            self.head = [] if cut else [*self.head, row[start:]]

    def finish(self) -> list[tuple]:
        if self.open and (self.inside or self.level != self.depth):
            self.emit(MORE if self.spans else BEGIN, b",".join(self.parts))
        self.made.append((self.range, FACTS, 0, None, self.section, self.closed, self.extra))
        return self.made


def _cut(spark: SparkSession, path: str, found: pa.Table, depth: int, salvage: bool) -> DataFrame:
    """The records (and parts of records) of the ranges in `found`, as PIECES."""
    # One entry a range: what the driver holds of them when it plans the scan, and no more.
    begins = {(r["file"], r["block"]): r for r in found.to_pylist()}
    shared = spark.sparkContext.broadcast(begins)

    def cutter(r: dict) -> Cutter:
        if salvage:
            opened = r["salvage_begun"] and r["salvage_depth"] >= depth
            made = Cutter(r["range"], depth, r["salvage_inside"], r["salvage_depth"], opened, r["salvage_begun"] and not opened, skips=not r["salvage_begun"])
        else:
            opened = r["depth"] >= depth
            made = Cutter(r["range"], depth, r["inside"], r["depth"], opened, r["begun"] and r["depth"] < depth and depth == 1)
        made.spans = made.open and (made.inside or made.level != depth)
        return made

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.bool_()]
        names = [x.split()[0] for x in PIECES.split(", ")]

        def batch(file: int, made: list[tuple]) -> pa.RecordBatch:
            columns = [[file] * len(made), *([m[i] for m in made] for i in range(7))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for k, rows in _runs(batches):
            if k != key:
                if now is not None:
                    yield batch(key[0], now.finish())
                r = shared.value.get(k)
                now, key = (cutter(r) if r else None), k
            if now is not None:
                now.feed(list(rows))
                if now.made:
                    yield batch(key[0], now.made)
                    now.made = []
        if now is not None:
            yield batch(key[0], now.finish())

    rows = segments(spark, path)
    if salvage:
        rows = rows.where(F.col("file").isin(*{f for f, _ in begins}))
    return rows.mapInArrow(cut, PIECES)


def _records(pieces: DataFrame) -> DataFrame:
    """file, pos, text and section of whole records: those of one range, and those put together from parts; a record without a section of its own has that of the range before."""
    facts = pieces.where(F.col("kind") == FACTS)
    before = "last(section, true) over (partition by file order by range rows between unbounded preceding and 1 preceding)"
    known = facts.selectExpr("file", "range", f"{before} as inherited")
    place = lambda number: (F.shiftleft("range", RANGE_BITS) + F.shiftleft(number, VALUE_BITS)).alias("pos")
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "range", place("number"), "text", "section")
    parts = pieces.where(F.col("kind").isin(BEGIN, MORE)).selectExpr("*", f"sum(if(kind = {BEGIN}, 1, 0)) over (partition by file order by range, number) as record")
    joined = F.array_sort(F.collect_list(F.struct("range", "number", "text")))
    spanning = parts.groupBy("file", "record").agg(F.min("range").alias("range"), F.min_by("section", F.struct("range", "number")).alias("section"), joined.alias("parts"))
    text = F.expr("aggregate(slice(parts, 2, size(parts)), parts[0].text, (whole, p) -> concat(whole, cast(',' as binary), p.text))")
    spanning = spanning.select("file", "range", place(F.lit(SPANNING).cast("long")), text.alias("text"), "section")
    return whole.unionByName(spanning).join(known, ["file", "range"]).select("file", "pos", "text", F.coalesce("section", "inherited").alias("section"))


_DECODE = json.JSONDecoder().raw_decode


def salvage(text: str) -> tuple[list, bool]:
    """The values that stand in the text, with blanks and commas between them, up to the first that isn't whole; and whether that was none."""
    made, at = [], 0
    while True:
        while at < len(text) and text[at] in " \n\r\t,":
            at += 1
        if at >= len(text):
            return made, True
        try:
            value, at = _DECODE(text, at)
        except ValueError:
            return made, False
        made.append(value)


def _parsed(records: DataFrame, pair: bool) -> DataFrame:
    """items (JSON of the values in a record), strict (it is one value, or one name and value), blank and clean (nothing in it is broken)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for raw in batch.column("text").to_pylist():
                try:
                    text = raw.decode()
                    value = json.loads("{" + text + "}" if pair else text)
                    values, strict = list(value.values()) if pair else [value], not pair or len(value) == 1
                    clean = True
                except ValueError:
                    strict = False
                    values, clean = salvage(raw.decode(errors="replace")) if not pair else ([], False)
                made.append(([json.dumps(v) for v in values], strict, not raw.strip(BLANKS), clean))
            kinds = (pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("pos"), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))], ["file", "pos", "items", "strict", "blank", "clean"])

    return records.select("file", "pos", "text").mapInArrow(parse, "file long, pos long, items array<string>, strict boolean, blank boolean, clean boolean")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so a file's text is cut once."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _judged(pieces: DataFrame, pair: bool, trailing: list[int]) -> tuple[DataFrame, DataFrame]:
    """Parsed records, and for each file whether it is whole and where its first broken record is. Files of `trailing` end with a comma."""
    parsed = _kept(_parsed(_records(pieces), pair), "json-records")
    ends = pieces.where(F.col("kind") == FACTS).groupBy("file").agg(F.max("closed").alias("closed"), F.max("extra").alias("extra"))
    found = parsed.groupBy("file").agg(F.min("strict").alias("strict"), F.count("*").alias("n"), F.max("blank").alias("blank"), F.min(F.when(~F.col("clean"), F.col("pos"))).alias("stop"))
    whole = F.col("closed") & ~F.col("extra") & (F.col("strict") | (F.col("blank") & (F.col("n") == 1)))
    whole &= ~F.col("file").isin(trailing) if trailing else F.lit(True)
    return parsed, ends.join(found, "file").select("file", "stop", F.coalesce(whole, F.lit(False)).alias("whole"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files: path, pos (ascending in the file, not gapless), json and truncated.

    Of a list its elements, of an object its values (those of repeated names, too). Of a file that isn't valid JSON the whole values behind its
    first `[`, up to the first that is broken or the list's end; bytes that are not UTF-8 are replaced there. A byte order mark is passed over. Other values and empty files have no records.
    """
    found = states(spark, path).toArrow()
    top = found["top"].to_numpy(zero_copy_only=False)
    by_file: dict[int, list[dict]] = {}
    for r in found.to_pylist():
        by_file.setdefault(r["file"], []).append(r)
    # Segments and a comma behind each are as long as a file that ends with one.
    trailing = [r["file"] for r in files(spark, path).select("file", "size").toArrow().to_pylist() if sum(x["bytes"] for x in by_file.get(r["file"], [])) == r["size"]]
    made = []
    for sign in "[{":
        own = found.filter(pa.array(top == ord(sign)))
        if not own.num_rows:
            continue
        pieces = _kept(_cut(spark, path, own, 1, salvage=False), "json-pieces")
        parsed, facts = _judged(pieces, sign == "{", trailing)
        if sign == "[":
            rows = parsed.join(facts, "file").where(F.col("whole") | F.col("stop").isNull() | (F.col("pos") <= F.col("stop")))
            made.append(rows.select("file", "pos", "items", (~F.col("whole")).alias("truncated")))
        else:
            made.append(parsed.join(facts.where("whole"), "file").select("file", "pos", "items", F.lit(False).alias("truncated")))
            broken = [r["file"] for r in facts.where("not whole").select("file").toArrow().to_pylist()]
            top = np.where(np.isin(found["file"].to_numpy(), broken), 0, top)
    rest = found.filter(pa.array(~np.isin(top, [ord("["), ord("{")])))
    if rest.num_rows:
        # Broken objects, and what is neither list nor object; a lone string is valid and has no records.
        pieces = _kept(_cut(spark, path, rest, 1, salvage=True), "json-pieces")
        parsed, facts = _judged(pieces, False, [])
        lone = [f for f in set(rest["file"].to_pylist()) if (x := by_file[f])[0]["top"] == QUOTE and sum(r["quotes"] for r in x) == 2 and [r["last"] for r in sorted(x, key=lambda r: r["range"]) if r["last"] >= 0][-1] == QUOTE]
        rows = parsed.join(facts, "file").where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).where(~F.col("file").isin(lone) if lone else F.lit(True))
        made.append(rows.select("file", "pos", "items", F.lit(True).alias("truncated")))
    if not made:
        return spark.createDataFrame([], "path string, pos long, json string, truncated boolean")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    out = out.select("file", "pos", F.posexplode("items").alias("k", "json"), "truncated")
    return out.join(files(spark, path), "file").select("path", (F.col("pos") + F.col("k")).alias("pos"), "json", "truncated")


def members(spark: SparkSession, path: str) -> DataFrame:
    """path, section, pos and json of the elements of all lists that are members of the files' outermost objects; section is the member's name."""
    found = states(spark, path).toArrow()
    own = found.filter(pa.array(found["top"].to_numpy(zero_copy_only=False) == ord("{")))
    pieces = _kept(_cut(spark, path, own, 2, salvage=False), "json-members")
    rows = _records(pieces).where("length(section) > 0").select("file", "section", "pos", F.col("text").cast("string").alias("json")).where("length(trim(BOTH ' \t\n\r' FROM json)) > 0")
    return rows.join(files(spark, path), "file").select("path", "section", "pos", "json")
