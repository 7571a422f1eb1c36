"""Files read in byte ranges give what json.loads gives, or the values before the cut, wherever ranges end."""

import json
import os
import random
from collections import defaultdict

import pytest

from scorelake.sources import json_ranges

R = random.Random(1)


def _value(depth=0):
    kind = R.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return R.choice(["a,b", 'x"y', "[{,", "\\", '\\"', "é漢", "", " ]}", "a\\,"])
    if kind in (1, 2):
        return R.choice([R.randint(-5, 999), None, True, 1.5])
    if kind == 3:
        return "w" * R.randint(0, 9)
    if kind == 4:
        return [_value(depth + 1) for _ in range(R.randint(0, 4))]
    return {R.choice(["k", "a,b", 'q"', "[x"]): _value(depth + 1) for _ in range(R.randint(0, 4))}


def _plain(raw):
    try:
        whole = json.loads(raw)
    except ValueError:
        return (json_ranges.salvage(raw[raw.index("[") + 1 :])[0] if "[" in raw else []), True
    return (list(whole.values()) if isinstance(whole, dict) else whole if isinstance(whole, list) else []), False


TEXTS = ['[{"a":1} {"b":2}, 3]', "[1,,2]", "[1,2,]", "[1,2],", "7", '"a[1,2]"', '"a[1,2', "oops [1,2] [3]", "[]", "{}", "[ ]", "[1] [2,3]", '{"a":[1,2],"b":', "[1, 2"]
for i in range(8):
    made = [_value() for _ in range(R.randint(1, 5))] if i % 3 else {f"k{j}": _value() for j in range(R.randint(1, 6))}
    shown = json.dumps(made, ensure_ascii=R.random() < 0.5, indent=R.choice([None, None, 1]))
    TEXTS += [shown, shown[: R.randint(0, len(shown))], shown + R.choice([" ", "]", ",", "x", "[1]"])]


@pytest.mark.parametrize("size", [61, 1 << 20])
def test_elements_of_files_in_ranges(spark, tmp_path, size, monkeypatch):
    # Small ranges hold for every file; kept in memory, the tables between don't get them.
    monkeypatch.setattr(json_ranges, "_kept", lambda df, name: df.cache())
    for i, text in enumerate(TEXTS):
        (tmp_path / f"f{i:03d}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = defaultdict(list)
        for r in json_ranges.elements(spark, str(tmp_path)).collect():
            got[int(os.path.basename(r.path)[1:4])].append((r.pos, r.json, r.truncated))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.catalog.clearCache()
    for i, text in enumerate(TEXTS):
        want, cut = _plain(text)
        rows = sorted(got[i])
        assert [r[1] for r in rows] == [json.dumps(v) for v in want], text
        assert len({r[0] for r in rows}) == len(rows) and all(r[2] == cut for r in rows), text


@pytest.mark.parametrize("seed", range(6))
def test_a_file_cut_at_every_comma(seed):
    """The cutter alone: any two ranges of a file give its records."""
    doc = [_value() for _ in range(3)]
    rows = json.dumps(doc).encode().split(b",")
    for k in range(1, len(rows)):
        first = json_ranges.Cutter(0, 1, False, 0, False, False)
        first.feed(list(rows[:k]))
        second = json_ranges.Cutter(1, 1, first.inside, first.level, first.level >= 1, False)
        second.spans = second.open and (second.inside or second.level != 1)
        second.feed(list(rows[k:]))
        pieces = [*first.finish(), *second.finish()]
        whole = [p[3] for p in pieces if p[1] == json_ranges.WHOLE]
        parts = [p[3] for p in pieces if p[1] in (json_ranges.BEGIN, json_ranges.MORE)]
        records = [json.loads(x) for x in [*whole, *([b",".join(parts)] if parts else [])]]
        assert sorted(map(json.dumps, records)) == sorted(map(json.dumps, doc))


def test_members_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_ranges, "_kept", lambda df, name: df.cache())
    doc = {"images": [{"id": i, "n": "a,b]"} for i in range(9)], "x": {"y": 1}, "none": [], "a,b": [[1, 2], {"q": [3]}], "notes": ["s", 1, None]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"notes": [7]}, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("50", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = json_ranges.members(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.catalog.clearCache()
        got = defaultdict(list)
        for r in sorted(rows, key=lambda r: r.pos):
            got[r.path[-6:], r.section].append(json.loads(r.json))
        assert dict(got) == {**{("a.json", k): v for k, v in doc.items() if isinstance(v, list) and v}, ("b.json", "notes"): [7]}
