"""Repeats: passages that very many documents hold, and texts taken many at a time, against plain versions."""

import random

import pytest

from scorelake.llm import common, line_dedup

R = random.Random(23)


def words(n):
    return " ".join("".join(R.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_common_passage_makes_no_row_for_each_occurrence(spark, monkeypatch):
    monkeypatch.setattr(common, "NEVER_HOT", 3)
    kept, passage = {}, " ".join(w.title() if i % 6 == 0 else w for i, w in enumerate(words(120).split()))
    plain = line_dedup.table

    def counted(df, name):
        made = plain(df, name)
        kept[name] = made[0].count()
        return made

    monkeypatch.setattr(line_dedup, "table", counted)
    rows = [(i, f"{words(R.randrange(30))} u{i} {passage} v{i} {words(5)}") for i in range(80)]
    for r in line_dedup.without_repeats(docs_of(spark, rows)).collect():
        assert [rows[r.doc_id][1][a:b] for a, b in r.removed] == ([passage] if r.doc_id else [])
    # Each of the 80 documents holds over 20 stretches of the passage.
    assert kept and max(kept.values()) <= 5 * len(rows)


@pytest.mark.parametrize("hot", [400, 3])
def test_runs_of_several_first_places(spark, monkeypatch, hot):
    """Texts put together from parts of others, touching or apart: hot or not, the same goes; what goes stands in an earlier place."""
    got = {}
    pool = [words(R.randint(26, 90)) for _ in range(12)]
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice([*pool, words(6), " ".join(r.choice(pool).split()[5:60])]) for _ in range(r.randint(1, 7)))) for i in range(90)]
    for limit in (10_000, hot):
        monkeypatch.setattr(common, "NEVER_HOT", limit)
        got[limit] = sorted((x.doc_id, x.text, x.removed, x.removed_lines) for x in line_dedup.without_repeats(docs_of(spark, rows)).collect())
    assert got[hot] == got[10_000] and sum(len(x[2]) for x in got[hot]) > 60
    seen = set()
    for i, text in rows:
        cut_out = next(x[2] for x in got[hot] if x[0] == i)
        for line in text.split("\n"):
            at, key = text.index(line), tuple(line.split())
            if len(key) >= 26 and key in seen and text.count(line) == 1:
                assert any(s.start <= at and at + len(line) <= s.end for s in cut_out)
            seen.add(key)


@pytest.mark.parametrize(("min_words", "min_line_words"), [(25, 1), (25, 25), (1, 1), (3, 50)])
def test_texts_many_at_a_time(min_words, min_line_words):
    """What a text gives doesn't depend on the texts beside it; short, empty and odd ones included; lines are words in a row."""
    r = random.Random(7)
    texts = [" ".join(r.choice(["a", "B", "c.", "Éa", "\n", "d\n", "É", "!"]) for _ in range(r.randrange(120))) for _ in range(60)] + ["", " \n", "x", "\n\n", words(300), "É"]
    r.shuffle(texts)
    data = [t.encode() for t in texts]
    of, *together = line_dedup.stretches(data, min_words, min_line_words)
    for i, text in enumerate(data):
        alone = line_dedup.stretches([text], min_words, min_line_words)
        assert all((x[of == i] == y).all() for x, y in zip(together, alone[1:], strict=True)) and (alone[0] == 0).all()
        spans, n = set(zip(alone[3].tolist(), alone[4].tolist(), strict=True)), 0
        for line in text.split(b"\n"):
            size = len(line.split())
            assert size < max(1, min_line_words) or (n, n + size) in spans
            n += size
        assert all(0 <= a < b <= n for a, b in spans)
    assert [(at, len(c)) for at, c in line_dedup._chunks(["x" * line_dedup.CHUNK, None, "y", "z" * line_dedup.CHUNK])] == [(0, 2), (2, 1), (3, 1)]
