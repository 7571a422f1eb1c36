"""The five stages on a small table, each against a plain version of its decisions."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from scorelake.llm import langid, quality  # noqa: E402
from scorelake.llm.queries import WORD_VOCABULARY  # noqa: E402
from tests.llm.test_brute_force import _text_groups  # noqa: E402

R = random.Random(21)
EN = "the and that with have this from they which would there their about some into other than then only over also".split()
DE = "und der die das nicht mit sich auch eine werden haben durch über sind nach wird einer oder aber wenn noch".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version int, removed string"


def said(pool, n):
    return " ".join(R.choice(pool) + R.choice(["", "", "", R.choice("abcdefgh")]) for _ in range(n))


def _rows():
    rows = []
    for i in range(260):
        pool, lang = (EN, "en") if i % 2 else (DE, "de")
        text = said(pool, R.randint(40, 120)).capitalize() + "."
        if i >= 200:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, lang))
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(10)]  # copies
    passage = said(EN, 60)
    rows += [(400 + i, f"{said(EN, 30)} u{i} {passage} v{i} {said(EN, 20)}", "en") for i in range(5)]
    rows += [(500, None, None), (501, "", None), (502, " \n", "en"), (None, said(EN, 50), "en"), (1, rows[1][1], "en"), (1, said(EN, 70), "en"), (503, " ".join("".join(R.choice("qxzvkj") for _ in range(6)) for _ in range(80)), None)]
    return [(i, t, lang, "s", len(t or ""), None, None) for i, t, lang in rows]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(_rows(), SCHEMA)
    docs.write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i < 200), 0) for i in range(260)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def _key(r):
    return r.doc_id, r.text


def test_stages_against_plain_versions(spark, table):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "language ID", "MinHash near-dedup", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{table}/documents.parquet")

    kept = stages["quality classifier"](spark, docs, table)
    model = quality.train(docs, spark.read.parquet(f"{table}/labels.parquet"))
    scores = model.scores([quality.features(r.text or "", r.n_chars) for r in docs.collect()])
    assert Counter(map(_key, kept.collect())) == Counter(_key(r) for r, s in zip(docs.collect(), scores, strict=True) if s >= 0.3)
    assert kept.columns == docs.columns and kept.where("doc_id < 200").count() >= 198 and kept.where("doc_id between 200 and 259").count() <= 2

    spoken = stages["language ID"](spark, kept, table)
    judge = langid.Scorer(langid.train(kept))
    before = kept.collect()
    assert Counter(map(_key, spoken.collect())) == Counter(_key(r) for r, ok in zip(before, judge.judge([r.text or "" for r in before])[2], strict=True) if ok)
    assert spoken.where("doc_id in (500, 501, 502)").count() == 0 and spoken.where("doc_id < 200").count() >= 195

    single = stages["MinHash near-dedup"](spark, spoken, table)
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    sets, groups = _text_groups(rows, 5, 80)
    low = {g: min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None) for g in set(groups)}
    stays = [(d, t) for k, (d, t) in enumerate(rows) if d is None or not sets[k] or d == low[groups[k]]]
    assert Counter(map(_key, single.collect())) == Counter(stays) and single.where("doc_id between 300 and 309").count() == 0
    assert {t for _, t in rows} == {t for _, t in stays}  # these copies are exact, so no text is lost

    cut = stages["substring dedup"](spark, single, table)
    was = {(r.doc_id, r.text): r for r in single.collect()}
    now = cut.collect()
    changed = [r for r in now if _key(r) not in was]
    assert cut.columns == docs.columns and {r.doc_id for r in changed} <= {400, 401, 402, 403, 404} and all(r.n_chars == len(r.text) for r in changed)
    held = sorted(r.doc_id for r in single.collect() if 400 <= (r.doc_id or 0) < 405)
    passages = [r for r in now if r.doc_id in held]
    first = next(r for r in passages if r.doc_id == held[0])
    assert _key(first) in was and len(changed) == len(held) - 1

    packed = stages["packing"](spark, cut, table).toPandas()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_VOCABULARY)
    assert packed.length.sum() == sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in now)
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all()
    one = next(r for r in now if r.doc_id == 7) if any(r.doc_id == 7 for r in now) else now[0]
    ids = np.array([*whole.encode(one.text, add_special_tokens=False).ids, 2], "<u4")
    for p in packed[packed.doc_id == one.doc_id].itertuples():
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_run_and_empty_tables(spark, table, tmp_path):
    out = corpus_pipeline.run(spark, table)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    spark.read.parquet(f"{table}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{table}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
