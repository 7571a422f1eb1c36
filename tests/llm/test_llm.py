"""Small cases for every training-data operator: brute force, round trips and the defined edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from scorelake.llm import byte_bpe, embed_dedup, gif, html_tree, langid, line_dedup, minhash, packing, quality, token_orc  # noqa: E402
from scorelake.llm.queries import BYTE_RANKS, WORD_VOCABULARY  # noqa: E402
from scorelake.llm.wordtok import tokenizer  # noqa: E402

RND = random.Random(4)
VOCAB = ["".join(RND.choice("abcdefgilmnorst") for _ in range(RND.randint(2, 8))) for _ in range(900)]
words = lambda n: " ".join(RND.choice(VOCAB) for _ in range(n))
BASE = words(300)
EDGE = [(1, BASE), (2, BASE), (3, BASE.replace(" ", "  ", 5)), (4, None), (5, ""), (6, " \n "), (7, "tiny Text"), (8, words(4000)), (7, "tiny Text"), (None, BASE), (9, " ".join([*BASE.split()[:290], *words(10).split()]))]
SCHEMA = "doc_id long, text string, lang string, digest string, rep int, score double, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "d", 1, 0.5, 2) for i, t in rows], SCHEMA)


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_VOCABULARY)
    pool = list("aaBc  \n\t'sdtre.,!?019é漢ßİ́  \x1c\x85<|>") + ["<|endoftext|>", "'ll", " \n"]
    texts = ["".join(RND.choice(pool) for _ in range(RND.choice([0, 3, 40, 300]))) for _ in range(400)]
    for text, got in zip(texts, tokenizer(WORD_VOCABULARY).encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rows = packing.harmonic_pack(frame(spark, EDGE), WORD_VOCABULARY, capacity=512).toPandas()
    assert (rows.groupby("sequence_id").length.sum() <= 512).all()
    at = rows.sort_values(["sequence_id", "offset"])
    assert ((at.offset + at.length).groupby(at.sequence_id).shift(1).fillna(0) == at.offset).all()
    tokens = sum(len(x) // 4 + 1 for x in tokenizer(WORD_VOCABULARY).encode_many([t or "" for _, t in EDGE]))
    assert rows.length.sum() == tokens
    data = tokenizer(WORD_VOCABULARY).encode(EDGE[7][1]) + (2).to_bytes(4, "little")
    for r in rows[rows.doc_id == 8].itertuples():
        assert zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    assert packing.harmonic_pack(frame(spark, []), WORD_VOCABULARY).count() == 0
    for n in range(1, 9000, 37):
        assert [c[0] for c in packing.cuts(n, 4096)] == list(np.cumsum([0, *(c[1] for c in packing.cuts(n, 4096))])[:-1])


def test_token_files(spark, tmp_path):
    folder = str(tmp_path / "t")
    token_orc.write_token_files(frame(spark, EDGE), folder, WORD_VOCABULARY)
    got = token_orc.token_index(token_orc.read_token_files(spark, folder)).toPandas().sort_values("start")
    assert len(got) == len(EDGE) and (got.n_tokens.cumsum().shift(1).fillna(0) == got.start).all()
    assert got.doc_id.dropna().is_monotonic_increasing
    assert token_orc.read_token_files(spark, folder, [7]).count() == 2


def test_byte_bpe(spark):
    import tiktoken

    bpe = byte_bpe.coder(BYTE_RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    pool = list("aaaabbc  \n\t'sdtre.,!?0123é漢字́  \x1c\x85<|>")
    for text in ["".join(RND.choice(pool) for _ in range(RND.choice([0, 5, 60, 700]))) for _ in range(300)] + ["a" * 5000, "abc" * 900]:
        (ids, back, n), = bpe.round_trips(pa.array([text]))
        assert bpe.encode(text) == other.encode_ordinary(text) and bytes(ids).decode() == " ".join(map(str, bpe.encode(text))) and bytes(back) == text.encode() and n == len(bpe.encode(text))
    rows = byte_bpe.byte_bpe(frame(spark, EDGE), BYTE_RANKS, public_tokenizers.PATTERN).toPandas()
    assert len(rows) == len(EDGE) and set(rows[rows.doc_id == 4].ids_sha256) == {hashlib.sha256(b"").hexdigest()}


def _plain_lzw(data, bits):
    """A plain decoder: a table of byte strings, a code at a time."""
    clear, out, acc, have = 1 << bits, [], 0, 0
    table, size, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
    for byte in data:
        acc, have = acc | byte << have, have + 8
        while have >= size:
            code, acc, have = acc & (1 << size) - 1, acc >> size, have - size
            if code == clear:
                del table[clear + 2 :]
                size, last = bits + 1, None
                continue
            if code == clear + 1 or last is None and code > clear or code > len(table) or code == len(table) == 4096:
                return b"".join(out)
            entry = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                size += len(table) == 1 << size and size < 12
            out.append(entry)
            last = entry
    return b"".join(out)


def _lzw(data, bits, clears=True):
    """A plain encoder with a growing table; without `clears`, a full table stays."""
    clear = 1 << bits
    table, size, acc, have, out = {bytes([i]): i for i in range(clear)}, bits + 1, 0, 0, bytearray()

    def put(code):
        nonlocal acc, have
        acc, have = acc | code << have, have + size
        while have >= 8:
            out.append(acc & 255)
            acc, have = acc >> 8, have - 8

    put(clear)
    last, following = b"", clear + 2
    for byte in data:
        if (longer := last + bytes([byte])) in table:
            last = longer
            continue
        put(table[last])
        if following == 4096 and not clears:
            pass
        elif following == 4096:
            put(clear)
            table, size, following = {bytes([i]): i for i in range(clear)}, bits + 1, clear + 2
        else:
            table[longer] = following
            size += following == 1 << size and size < 12
            following += 1
        last = bytes([byte])
    put(table[last])
    put(clear + 1)
    return bytes(out) + (bytes([acc]) if have else b"")


def test_gif(spark):
    payloads = [RND.randbytes(n) for n in (64, 64 * 1025, 64 * 3000)] + [(text * (n + 1))[:n].encode() for text, n in (("a", 64 * 700), (BASE, 64 * 59), (BASE, 64 * 60))]
    for data, made, stored in zip(payloads, gif.decode_many(gif.encode_payloads(payloads)), gif.encode_payloads(payloads), strict=True):
        assert b"".join(f.indices.tobytes() for f in made.frames) == data
        assert b"".join(_plain_lzw(x.data, x.least_bits) for x, _ in gif._parse(stored)[1]) == data
    assert len(gif.encode_payloads([payloads[3]])[0]) < 0.2 * len(payloads[3])
    streams = []
    for bits, n, kinds in ((8, 100_000, 3), (8, 30_000, 256), (2, 9000, 4), (5, 20_000, 32), (8, 0, 1)):
        data = bytes(RND.randrange(kinds) for _ in range(n))
        coded = _lzw(data, bits) if n else b"\x00"
        streams += [(data, gif.Stream(coded, bits, n)), (data[: n // 2], gif.Stream(coded, bits, n // 2)), (_plain_lzw(coded[: n // 9], bits), gif.Stream(coded[: n // 9], bits, n))]
        streams.append((_plain_lzw(never := _lzw(data, bits, clears=False), bits)[:n], gif.Stream(never, bits, n))) if n else None
    for (data, _), got in zip(streams, gif.lzw_decode([s for _, s in streams]), strict=True):
        assert got.tobytes() == data
    for _ in range(60):
        noise, bits = RND.randbytes(300), RND.choice((2, 4, 8))
        (got,) = gif.lzw_decode([gif.Stream(noise, bits, 5000)])
        assert got.tobytes() == _plain_lzw(noise, bits)[:5000]
    pixels = bytes(RND.choice((0, 1, 1, 2, 3)) for _ in range(60 * 90))
    head = b"GIF89a" + bytes([60, 0, 90, 0, 0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    control = b"\x21\xf9\x04\x05\x07\x00\x03\x00"
    data = head + control + b"\x2c" + bytes([0, 0, 0, 0, 60, 0, 90, 0, 0]) + b"\x02" + gif._blocks(_lzw(pixels, 2)) + b"\x3b"
    image = gif.decode(data)
    assert image.frames[0].indices.tobytes() == pixels
    (shown, delay), = gif.render(image)
    assert delay == 7 and (shown[..., 3] == 0).sum() == pixels.count(3) and sum(gif.histogram(shown)[:16]) == len(pixels) - pixels.count(3)
    rows = gif.text_media(frame(spark, EDGE)).toPandas()
    assert set(rows[rows.doc_id == 4].payload_bytes) == {64} and len(set(rows[rows.doc_id.isin([1, 2])].media_sha256)) == 1
    bad = gif.media_columns(spark.createDataFrame([(1, b"no"), (2, None)], "id long, gif binary")).toPandas()
    assert bad.error.notna().all()


def test_pages(spark):
    page = '<html><head><title>t</title><script>var x="</p>"</script></head><body><nav><ul><li><a href=a>m</a></ul></nav><div class="ad">Buy this</div><article><h1>T &amp; U</h1><p>One <b>two<br>three<p>Four</article><div id="comments"><p>a reader says so</p></div><footer>&copy; x</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page)], "page_id long, url string, html string")
    got = html_tree.main_text(rows).toPandas().sort_values("page_id")
    assert got.text.tolist() == ["T & U\nOne two three\nFour"] * 2 + ["", ""]
    model, right, seen = html_tree.default_model(), 0, 0
    for html, test in html_tree.training_pages(80, seed=5):
        nodes = html_tree.parse(html)
        p = model.marginals(nodes)
        for i, node in enumerate(nodes):
            if node.tag == "#":
                seen, right = seen + 1, right + ((p[i][1] >= 0.5) == test("".join(node.text)))
    assert right / seen > 0.97


@pytest.mark.parametrize("broken", [
    '<svg class="icon" viewBox="0 0 9 9"/>', "<svg><path d=x>", "<svg><path d=x/><text>no</text></svg>", "<div><select><option>no</div>", "<select><option>no</select>",
    "<object data=x>", "<div><object data=x>no</div>", "<object><p>no</object>", "<template>", "<template><div>no</template>", "<svg/><p></p>", "<table><tr><td><svg/></table>",
])
def test_page_goes_on_after_hidden_elements(broken):
    page = f"<html><body><nav><ul><li><a href=a>m</a></ul></nav>{broken}<article><h1>Title</h1><p>One two three.</p><p>Four <svg class=x/> five.</p></article><footer><svg><path d=x></svg>x</footer>"
    for shown in (page, page.replace("<footer>", "<footer><select><option>b</select>")):
        assert html_tree.default_model().extract(shown) == "Title\nOne two three.\nFour five."


def test_near_duplicates(spark):
    got = minhash.near_duplicates(frame(spark, EDGE), 4, 80).toPandas()
    assert len(got) == len(EDGE)
    by = dict(zip(got.doc_id, got.component_id, strict=True))
    assert by[1] == by[2] == by[3] == by[9] == 1 and by[4] == 4 and by[5] == 5 and by[8] == 8
    assert got[got.doc_id.isna()].kept.all()
    assert minhash.near_duplicates(frame(spark, []), 4, 80).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + 0.02 * rng.normal(size=16)).tolist(), "c") for i in range(60)] + [(100, None, "c"), (101, [0.0] * 16, "c"), (102, [float("nan")] * 16, "c"), (None, base[0].tolist(), "c"), (103, base[1].tolist(), "c"), (104, base[1].tolist(), "c")]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")).toPandas()
    x = {i: np.array(v) for i, v, _ in rows if i is not None and i not in (100, 101, 102)}
    links = {i: sum(i != j and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9 for j, w in x.items()) for i, v in x.items()}
    assert {r.vec_id: r.n_links for r in got.itertuples() if r.vec_id in x} == links
    assert set(got[got.vec_id.isin([100, 101, 102])].n_links) == {0} and len(got) == len(rows)


def test_repeats(spark):
    passage = "Once upon a time there were many words here. They went on for long enough to be found again by anyone. So it is removed later, as it must be, from texts behind."
    rows = [(1, f"{words(30)} {passage} {words(30)}"), (2, f"{words(20)}\n{passage} {words(9)}"), (3, words(50)), (4, None), (5, ""), (None, passage)]
    got = {r.doc_id: r for r in line_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and passage not in got[2].text and len(got[2].removed) == 1 and got[2].lang == "xx"
    start, end = got[2].removed[0]
    assert rows[1][1][start:end] == passage
    assert got[3].text == rows[2][1] and got[4].text is None and got[5].text == "" and got[None].text == passage


def test_repeats_at_any_word(spark):
    rnd = random.Random(11)
    plain = lambda n: " ".join(f"w{rnd.randrange(50000)}" for _ in range(n))
    titled = lambda n: " ".join(w.title() if rnd.random() < 0.1 else w for w in plain(n).split())
    rows, slices = [], {}
    for i in range(120):
        source = (plain if i % 2 else titled)(200).split()
        n, at = rnd.choice((51, 55, 60, 80)), rnd.randrange(1, 110)
        slices[1000 + i] = " ".join(source[at : at + n])
        rows += [(i, " ".join(source)), (1000 + i, f"{plain(rnd.randrange(40))} u{i} {slices[1000 + i]} v{i} {plain(30)}".strip())]
    got = {r.doc_id: r for r in line_dedup.without_repeats(frame(spark, rows)).collect()}
    for i, text in rows:
        cut_out = [text[a:b] for a, b in got[i].removed]
        assert cut_out == ([slices[i]] if i in slices else []), i


def test_quality(spark):
    good, bad = [(i, words(60).capitalize() + ".") for i in range(120)], [(i, " ".join(w.upper() + "!!" for w in words(60).split())) for i in range(200, 320)]
    docs = frame(spark, [*good, *bad, (900, None), (901, "")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    got = quality.quality_scores(docs, quality.train(docs, labels)).toPandas().set_index("doc_id")
    assert got.loc[[i for i, _ in good]].predicted.mean() > 0.95 and got.loc[[i for i, _ in bad]].predicted.mean() < 0.05
    assert got.score.between(0, 1).all()
    empty = quality.train(docs, labels.limit(0))
    assert quality.keep_quality(docs, empty).columns == docs.columns


def test_language(spark):
    en, de = "the and that with have this from they which would there their about".split(), "und der die das nicht mit sich auch eine werden haben durch über".split()
    rows = [(i, " ".join(RND.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "123 !!", None)], "doc_id long, text string, lang string")
    got = langid.languages(docs, langid.train(docs)).toPandas().set_index("doc_id")
    assert all(got.loc[i].lang_pred == lang for i, _, lang in rows) and got.loc[900].lang_pred == got.loc[901].lang_pred == "und"
    assert langid.languages(docs, langid.train(docs.limit(0))).where("lang_pred = 'und'").count() == 202


def test_language_with_wrong_labels(spark):
    rnd = random.Random(3)
    en, de = "the and that with have this from they which would there their about".split(), "und der die das nicht mit sich auch eine werden haben durch über".split()
    fi = "että oli hän mutta kuin myös sekä joka tämä olla voi kun jos niin mukaan jälkeen".split()
    said = lambda pool: " ".join(rnd.choice(pool) for _ in range(40))
    noise = lambda: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8))) for _ in range(60))
    rows = [(i, said(en if i % 2 else de), "en" if i % 2 else "de") for i in range(1600)]
    rows += [(2000 + i, noise(), "en" if i % 2 else "de") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    asked = spark.createDataFrame([*rows[:200], *((5000 + i, said(fi) if i % 2 else noise(), "") for i in range(40))], docs.schema)
    got = langid.languages(asked, model).toPandas().set_index("doc_id").accepted
    assert got[got.index < 200].all() and not got[got.index >= 5000].any()
