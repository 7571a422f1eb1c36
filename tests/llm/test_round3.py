"""Toxicity, Merkle manifests and alignment against plain versions of what they compute; pages in layouts and words that the page model's lists do not know."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from scorelake.llm import align, html_tree, merkle, toxicity  # noqa: E402
from scorelake.llm.queries import BYTE_VOCABULARY, PIECES  # noqa: E402

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))


# op11

STEMS = ["grumb", "zott"]


def _texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgilmnorst") for _ in range(r.randint(2, 8)))
    pool, out = [word() for _ in range(400)], []
    for i in range(n):
        made = [[r.choice(pool) for _ in range(r.randint(3, 14))] for _ in range(r.randint(1, 40))]
        toxic, where = r.random() < 0.25, set()
        if toxic:
            for k in r.sample(range(len(made)), min(len(made), r.randint(1, 3))):
                made[k].insert(r.randint(0, len(made[k])), r.choice(STEMS) + word())
                where.add(k)
        out.append((i, ". ".join(" ".join(s).capitalize() for s in made) + ".", int(toxic), where))
    return out


def test_toxicity_learns_from_documents_and_points_at_sentences(spark):
    rows = _texts(1500, 3)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _, _ in rows], "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y, _ in rows] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    held = [(got[i].predicted, y) for i, _, y, _ in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert not any(p and not y for p, y in held)
    spans = defaultdict(set)
    for r in toxicity.offending_sentences(docs, model).collect():
        text = rows[r.doc_id][1]
        assert text[r.begin : r.end] == r.sentence
        spans[r.doc_id].add(text[: r.begin].count("."))
    found = sum(spans[i] == where for i, _, y, where in rows if y and got[i].held_out)
    assert found / sum(y for i, _, y, _ in rows if got[i].held_out) > 0.9


def test_noisy_or_and_its_gradient():
    model = toxicity.Model(-2.0, {toxicity.features("bad")[0]: 3.0})
    p = [1 / (1 + np.exp(-z)) for z in (1.0, -2.0)]
    assert model.score("A bad one. A good one!") == pytest.approx(1 - (1 - p[0]) * (1 - p[1]))
    assert [round(s, 6) for *_, s in model.sentence_scores("A bad one. A good one!")] == [round(x, 6) for x in p]
    assert [list(toxicity.sentences(t)) for t in ("", " \n ", "a\nb", "a...b")] == [[], [], [(0, 2), (2, 3)], [(0, 4), (4, 5)]]


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "plain"), (4, "plain"), (None, "bad " * 30_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(4, 0), (4, 0)], "doc_id long, toxic int")):
        model = toxicity.train(docs, labels)
        got = toxicity.toxicity_scores(docs, model).collect()
        assert len(got) == 6 and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3)) and all(0 <= r.score < 0.7 for r in got)
        assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0
        assert toxicity.offending_sentences(docs, model, 0.7).count() == 0


# op12


def _manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = H(*map(field, (doc_id, source, lang, n_chars, text)))
        tampered = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        seen = H(*map(field, (doc_id, source, lang, n_chars, text.replace("\n", "") if tampered else text)))
        trees[source].append((doc_id is not None, doc_id or 0, leaf, seen, doc_id))

    def tree(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run = a // 3 * 3
                proofs[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + 3])))
            at, nodes = [a // 3 for a in at], [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        return nodes[0], proofs

    made = []
    for source in sorted(trees, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(trees[source], key=lambda x: x[:3])
        made.append((leaves, *tree([x[2] for x in leaves])))
    root, tops = tree([sub for _, sub, _ in made]) if made else (None, [])
    for (leaves, sub, proofs), top in zip(made, tops, strict=True):
        for (_, _, leaf, seen, doc_id), proof in zip(leaves, proofs, strict=True):
            h = seen
            for left, right in proof + top:
                h = H(left, h, right)
            yield doc_id, leaf, sub, root, H(*(x + y for x, y in proof + top)), h, h == root


MANY = [(i, "ab"[i % 7 == 0], "en", 3, f"line\n{i}" if i % 3 else None) for i in range(100)]
ODD = [(1, "s", "en", 3, "a\nb"), (1, "s", "en", 3, "a\nb"), (None, "s", None, None, None), (2, None, "en", 3, "x"), (3, "", None, None, ""), (None, None, None, None, "q\n"), (5, "ß", "de", 1, "\n"), (6, "-", "x", 9, "word " * 50_000)]


@pytest.mark.parametrize("rows", [MANY, ODD + [(i, "t", "x", 1, f"l\n{i}") for i in range(28)], ODD[:2], ODD[3:4], []], ids=["many", "odd", "repeated", "one", "empty"])
def test_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], f"{DOCS}, grp string, place int")
    now = merkle.without_line_feeds(docs, FIELDS, F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    same(map(tuple, merkle.verified(docs, FIELDS, "source", "doc_id", now).collect()), list(_manifest(rows)))


def test_manifest_levels_that_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL_LEVEL", 0)
    docs = spark.createDataFrame(MANY, DOCS)
    got = merkle.verified(docs, FIELDS, "source", "doc_id").collect()
    assert all(r.verified for r in got) and {r.root for r in got} == {x[3] for x in _manifest(MANY)}


# op13


def _alignments(rows):
    of = align.Tokenizers(BYTE_VOCABULARY, PIECES)
    bytes_a, bytes_b = of.bytes_a.to_pylist(), of.bytes_b.to_pylist()
    made = []
    for doc_id, text in rows:
        groups, want = None, (" " + (text or "")).encode()
        if text:
            a, b = of._a.encode(" " + text, add_special_tokens=False).ids, of._b.encode(text)
            if b"".join(bytes_a[i] for i in a) == want == b"".join(bytes_b[i] for i in b):
                ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, bytes_a), (b, bytes_b))]
                groups, at = [], [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [e.index(cut) + 1 for e in ends]
                    groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                    at = to
        made.append((doc_id, groups))
    links = lambda groups: [(x, y) for a, b in groups for x in a for y in b]
    held = Counter(p for _, g in made if g for p in set(links(g)))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    for doc_id, groups in made:
        if not groups:
            yield doc_id, 0, 0, 0, 0, 0, 0, ""
            continue
        own = links(groups)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own), sum(held[p] == top[p[0]] for p in own), sum(held[p] for p in own), H(shown)


PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "the", " the", "é", "ß", "▁", "。", "漢字", "😀", "\t", "'s", " 's", "<s>", "</s>", "<0x41>", "<|endoftext|>", "<unk>", "====", " ", "　", "\r\n", "0", "123", "×", "\u0000", "ﬁ", "aaaaaaaaaa", "é", "▁ ", "."]
EDGES = [(None, "x"), (5, None), (6, ""), (7, "same text"), (7, "same text"), (8, " "), (9, "\n"), (10, "a" * 3001), (11, "ab " * 5000 + "é"), (12, "=" * 999 + "-" * 77)]


@pytest.mark.parametrize("wide", [align.WIDE, 2])
def test_alignments(spark, wide, monkeypatch):
    monkeypatch.setattr(align, "WIDE", wide)
    r = random.Random(3)
    rows = EDGES + [(i, "".join(r.choice(PARTS) for _ in range(r.randint(1, 30)))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, pair int").repartition(3)
    same(map(tuple, align.alignments(docs, BYTE_VOCABULARY, PIECES).collect()), list(_alignments(rows)))
    assert align.alignments(docs.limit(0), BYTE_VOCABULARY, PIECES).count() == 0


def test_rank_and_select():
    r = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        ends = np.flatnonzero(r.random(n) < 0.4) + 1
        words = align.bitset(ends, n)
        assert align.select(words).tolist() == (ends - 1).tolist()
        places = np.arange(n)
        assert align.rank(words, places).tolist() == np.searchsorted(ends, places + 1, side="right").tolist()


# op2

FIRST = "The ferry left at six in the morning. Nobody had told the crew that the tide would turn so early, and the pilot was still asleep."
SECOND = "By noon the wind had risen to a gale. We waited for the second boat, which never came, and walked home along the quay."


def _page(body):
    return f"<html><head><title>x</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>Ships</a></li></ul></nav>{body}<footer><p>Harbour Times 1999</p></footer></body></html>"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("h", ["h1", "h2"])
def test_an_article_about_comments_or_rights_stays(tag, h):
    model = html_tree.default_model()
    for word in sorted(html_tree._TELL_OF):
        for head in (f"{word.capitalize()} in the harbour", word.capitalize(), f"{word.capitalize()} law explained"):
            assert model.extract(_page(f"<{tag}><{h}>{head}</{h}><p>{FIRST}</p><p>{SECOND}</p></{tag}>")) == f"{head}\n{FIRST}\n{SECOND}"


@pytest.mark.parametrize("tag", ["article", "div", "main"])
@pytest.mark.parametrize("n", [2, 6])
def test_lists_of_links_in_an_article_stay(tag, n):
    links = [f"Harbour guide number {i}" for i in range(n)]
    page = f"<{tag}><h1>Tides in the harbour</h1><p>{FIRST}</p><ul>" + "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(links)) + f"</ul></{tag}>"
    assert html_tree.default_model().extract(_page(page)) == "\n".join(["Tides in the harbour", FIRST, *links])


COMMENTS = "".join(f"<div><b>{a}</b> <span>vor {i} Tagen</span><p>{t}</p></div>" for i, (a, t) in enumerate([("Hans", "Das habe ich auch gesehen. Es war sehr laut."), ("Greta", "Ich nicht, aber mein Bruder war da und hat Bilder gemacht."), ("Otto", "Schade.")], 2))
MORE = "<div><h3>More from us</h3><ul><li>Ships of the north</li><li>Winter storms</li><li>Old maps</li></ul></div>"


@pytest.mark.parametrize("tag", ["article", "div", "main", "section"])
@pytest.mark.parametrize("after", [COMMENTS, f"<div>{COMMENTS}</div>", MORE], ids=["comments", "nested", "more"])
def test_what_follows_an_article_without_a_name_goes(tag, after):
    page = f"<{tag}><h1>Tides in the harbour</h1><p>{FIRST}</p><p>{SECOND}</p></{tag}>{after}"
    assert html_tree.default_model().extract(_page(page)) == f"Tides in the harbour\n{FIRST}\n{SECOND}"


def test_repeated_pages_and_ties(spark):
    rows = spark.createDataFrame([(1, "u", _page(f"<article><h1>T</h1><p>{FIRST}</p></article>"))] * 3 + [(None, None, "<p>"), (2, "v", "&nbsp;")], "page_id long, url string, html string")
    got = html_tree.main_text(rows.withColumn("text", F.lit("x"))).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter({(1, f"T\n{FIRST}"): 3, (None, ""): 1, (2, ""): 1})


@pytest.mark.parametrize("tag", ["article", "div", "main"])
@pytest.mark.parametrize("n", [2, 40])
def test_articles_without_a_heading_stay(tag, n):
    body = f"<{tag}>" + "".join(f"<p>{i} {FIRST}</p>" for i in range(n)) + f"</{tag}>"
    assert html_tree.default_model().extract(_page(body)) == "\n".join(f"{i} {FIRST}" for i in range(n))
