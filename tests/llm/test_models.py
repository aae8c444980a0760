"""Tokenizers, classifiers, page and licence models, on small tables and edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from sigloom.llm import (
    html_extract,
    id_coder,
    language_id,
    license_scan,
    sentencepiece_bpe,
    token_output,
    toxicity,
)
from sigloom.llm.license_texts import TEMPLATES, UNKNOWN

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "   ", "\n", "a", "  a  b ", "a\tb\nc", "▁x ▁", "x▁y", "<s> </s> <unk>", "é ﬁ",
    "\0a \0", "\n\n x\n", "a \n b", "😀 日本 語", "it's  ok", "\r\n x", "a" * 3000 + " b", "\x85 \x1c b",
    "a " * 2000, "same", "same", "Hello, world! Hello, world.",
]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# SentencePiece


def test_sentencepiece_equals_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t, "kept") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    coded = sentencepiece_bpe.encode(docs, PIECES)
    back = sentencepiece_bpe.decode(coded, PIECES, name="back")
    found = {r["doc_id"]: r for r in back.collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "")
        assert found[i]["ids"] == ids and found[i]["back"] == library.decode(ids)
        assert found[i]["d"] == "kept"
    for r in sentencepiece_bpe.digests(docs, PIECES).collect():
        ids = library.encode(ODD[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sentencepiece_bpe.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece_bpe.digests(docs.limit(0), PIECES).count() == 0


def test_sentencepiece_decodes_any_ids():
    own = sentencepiece_bpe.Encoder(open(PIECES, "rb").read())
    for ids in ([], [1, 2], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [450, 3 + 0xE2, 3 + 0x82, 3 + 0xAC]):
        assert own.decode(ids) == own.library.decode(ids)


def test_sentencepiece_difference_is_an_error():
    own = sentencepiece_bpe.Encoder(open(PIECES, "rb").read())
    own.units["word"] = ("5", "x")
    with pytest.raises(ValueError, match="otherwise"):
        own.check(["word"])


def test_sentencepiece_checks_every_unit(monkeypatch):
    own = sentencepiece_bpe.Encoder(open(PIECES, "rb").read())
    for text in ODD:
        own.encode(text)
    merge, plain = own.vocabulary.merge, own.vocabulary.plain
    monkeypatch.setattr(own.vocabulary, "merge", lambda t: [5] if t == "▁wrong" else merge(t))
    own.encode("right word")
    for text in ("right wrong word", "wrong\0 x"):
        with pytest.raises(ValueError, match="otherwise"):
            own.encode(text)
    own.units.clear()
    monkeypatch.setattr(own.vocabulary, "merge", merge)
    monkeypatch.setattr(own.vocabulary, "plain", lambda ids: plain(ids) + "x")
    with pytest.raises(ValueError, match="otherwise"):
        own.encode("word")
    with pytest.raises(ValueError, match="otherwise"):
        own.check_ids([[450]])


# Token ids in files


def test_id_coder_round_trips():
    rng = np.random.default_rng(5)
    for lanes, steps, top in ((1, 1, 5), (3, 40, 50_257), (5, 700, 0xFFFE), (2, 2000, 2), (4, 900, 60)):
        ids = rng.integers(0, top, (lanes, steps))
        blocks = id_coder.encode_lanes(ids)
        assert (id_coder.decode_lanes(blocks, steps) == ids).all()
        # A block needs no other.
        assert (id_coder.decode_lanes(blocks[-1:], steps) == ids[-1:]).all()
    assert sum(map(len, id_coder.encode_lanes(np.zeros((1, 4000), int)))) < 200


@pytest.mark.parametrize("stripe", [6_000_000, 50])
def test_token_files_equal_library(spark, monkeypatch, stripe):
    monkeypatch.setattr(token_output, "STRIPE", stripe)
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = [(len(ODD) - i, t) for i, t in enumerate(ODD)] + [(None, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in token_output.report(docs, BYTES).collect()}
    before = 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected = (doc_id, before, len(ids), zlib.crc32(ids.tobytes()))
        assert tuple(found[doc_id]) == expected
        before += len(ids)
    assert token_output.report(docs.limit(0), BYTES).count() == 0


def test_damaged_block_is_an_error():
    sizes, crcs, payload = token_output._coded(np.arange(2000, dtype=np.uint16))
    bad = bytearray(payload)
    bad[len(bad) // 2] ^= 0x55
    with pytest.raises(ValueError, match="damaged"):
        token_output._decoded(2000, sizes, crcs, bytes(bad))


# Language


def test_languages(spark):
    rng = random.Random(2)
    words = {
        "aa": ["bala", "tama", "kala", "mara"],
        "bb": ["bisi", "timi", "kili", "miri"],
    }
    rows = [(i, " ".join(rng.choices(words[l], k=20)), l) for i, l in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "12 34!", "aa"), (502, "", None), (503, "tili bili", None)]
    rows += [(504, "balamara", None), (None, "kala kala", "aa"), (505, "щщщ", None)]
    rows += [(600 + i, t, None) for i, t in enumerate(["½", "² ①", "Ⅷ", "٣_", "½²①Ⅷ"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.report(docs).collect()}
    assert all(found[i]["lang_pred"] == l for i, _, l in rows[:120])
    assert all(found[i]["held_out"] == held(i) for i, *_ in rows[:120])
    assert [found[i]["lang_pred"] for i in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "bb", "aa", "aa"]
    assert found[505]["lang_pred"] in ("aa", "bb")
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in range(600, 605))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    nothing = docs.limit(0)
    assert language_id.report(nothing).count() == 0
    assert language_id.predict(docs, language_id.fit(nothing)).where("language.lang_pred != 'und'").count() == 0


# Toxicity


def test_matcher():
    m = toxicity.Matcher(["scum", "badword"], ["foul"], ["badword"])
    exact = ["badword", "scum"]
    close = ["badwrd", "badwoord", "badwxrd", "adword", "badwordx", "xbadword"]
    assert [m.match(w) for w in exact] == [m.EXACT] * 2
    assert [m.match(w) for w in close] == [m.CLOSE] * 6
    assert [m.match(w) for w in ("foul", "foulest")] == [m.STEMMED] * 2
    assert [m.match(w) for w in ("", "scumm", "bdwrd", "badwo", "good", "fou")] == [0] * 6
    assert m.close_terms("badwrd") == ["badword"] and m.close_terms("badword") == []


def test_matcher_counts_a_swap_as_one_edit():
    m = toxicity.Matcher(["scum", "badword"], ["badw"], ["badword"])
    swapped = ["abdword", "bdaword", "badowrd", "badwodr"]
    assert [m.match(w) for w in swapped[:3]] == [m.CLOSE] * 3 and m.match(swapped[3]) == m.STEMMED
    assert [m.close_terms(w) for w in swapped] == [["badword"]] * 4
    assert [m.match(w) for w in ("scmu", "abdwrd", "abdwo", "bdawor", "abdwordx", "ab", "bda")] == [0] * 7


def test_signs_inside_words():
    model = toxicity.Model(["moron", "scum"], [], ["moron"])
    plain = model.features("the man said nothing at all")
    for text in ("m0ron", "x-M0ron!", "mo@ron", "mor*n", "moro.n", "a m_ron b"):
        assert model.features(text)[2] > 0 == model.features(text)[1], text
    # A part that is a hit stays one.
    assert model.features("scum2moron")[1] == pytest.approx(np.log1p(2))
    assert model.features("moron,you")[1:3] == model.features("moron you")[1:3]
    for text in ("m0r0n", "m0 ron", 'm"ron', "scu3", "sc-um", "12 m0"):
        assert model.features(text)[1:] == plain[1:], text


def test_terms_under_a_stem_keep_their_edits(spark):
    kinds = [f"grubby{x}" for x in ("ola", "eti", "anu", "isk", "ump", "yro")]
    rows = [(1, f"some plain {w} text here") for w in kinds for _ in range(6)]
    rows += [(0, "some plain text here is g-ubbyola")] * 40
    words, stems, edited = toxicity.lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert stems == ["grub"] and words == []
    assert edited == sorted(set(kinds) - {"grubbyola"})  # common in harmless texts with a sign
    m = toxicity.Matcher(words, stems, edited)
    assert [m.match(w) for w in ("gurbbyeti", "grxbbyeti", "rubbyeti")] == [m.CLOSE] * 3
    assert m.match("grubbyeti") == m.match("grubbyxti") == m.STEMMED


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [f"p{chr(97 + i)}{chr(97 + j)}lum" for i in range(9) for j in range(9)]
    bad = ["nastyword", "vileword", "rottenest"]
    docs, labels = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        words = rng.choices(plain, k=40)
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs += [(900, None), (901, ""), (902, "you nastywrd, you vilewordd"), (903, 'he said "vileword" once'), (904, "vileword vileword")]
    labels += [(None, 1), (5, None), (77_777, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.report(d, l).collect()}
    assert all(found[i]["predicted"] == t for i, t in labels[:400])
    assert found[900]["predicted"] == found[901]["predicted"] == 0
    assert found[902]["predicted"] == 1 and found[904]["predicted"] == 1
    assert found[903]["score"] < found[904]["score"]
    assert found[900]["score"] == found[901]["score"] and found[7]["held_out"] == held(7)
    assert toxicity.report(d.limit(0), l).count() == 0
    unlabelled = toxicity.report(d, l.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.0}


# Pages


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><a href="/a">Home page</a><a href="/b">Other page</a></nav>
<article><h1>Head &amp; tail</h1><p>First   paragraph, with some
words in it; it is not short at all.<p>Second <b>bold</b> paragraph, which goes on for a while, too.</p>
<div class="comments"><p>I do not agree with this article, said a reader.</p></div></article>
<form><p>Your name, please, and your address.</p><input></form><footer>&copy; Somebody</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u1", PAGE), (2, "u2", None), (3, None, ""), (4, "u4", "<p"), (None, "u5", PAGE)]
    rows += [(6, "u6", "<div>" * 3000), (1, "u1", PAGE), (7, "u7", "<![CDATA[x]]><b></p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = (
        "Head & tail First paragraph, with some words in it; it is not short at all. "
        "Second bold paragraph, which goes on for a while, too."
    )
    found = html_extract.report(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["text"] == (text if r["url"] in ("u1", "u5") else "")
        assert r["n_chars"] == len(r["text"])
    assert html_extract.report(pages.limit(0)).count() == 0


def test_pages_marked_by_hand():
    pages = [html_extract.Page(h) for h in html_extract.LABELLED]
    truths = [p.truth(False) for p in pages]
    model = html_extract.Model.trained([(p, t, 1.0) for p, t in zip(pages, truths)])
    for html, page, truth in zip(html_extract.LABELLED, pages, truths):
        assert model.extract(html) == " ".join(t for t, y in zip(page.text, truth) if t and y)


def test_messages_give_marginals():
    """Against sums over all labellings of a small tree."""
    page = html_extract.Page("<div><p>one.</p><ul class=menu><li>two</li></ul></div><main>three</main>")
    rng = np.random.default_rng(1)
    model = html_extract.Model(rng.normal(size=html_extract.N_FEATURES), rng.normal(size=4))
    n = len(page.parent)
    own = page.x @ model.weights
    total, yes, agree = 0.0, np.zeros(n), np.zeros(n)
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        same = [1 if y[i] == y[page.parent[i]] else -1 for i in range(n)]
        e = sum(own[i] * y[i] for i in range(n))
        e += sum(same[i] * model.couplings[page.kind[i]] / 2 for i in range(1, n))
        p = np.exp(e)
        total += p
        yes += p * np.array(y)
        agree += p * np.array(same)
    p, a = model.marginals(page)
    assert np.allclose(p, yes / total) and np.allclose(a[1:], (agree / total)[1:])


# Licences


@pytest.fixture(scope="module")
def licences(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choices(["the", "river", "rose", "again", "in", "this", "town", "and", "all"], k=30)) for _ in range(300)]
    rows = [(i, line + "\n" + lines[(i + 1) % 300]) for i, line in enumerate(lines)]
    rows += [(1000 + i, f"{lines[i]}\n{t}\n") for i, t in enumerate(t for some in TEMPLATES.values() for t in some)]
    rows += [(2000 + i, f"{lines[i]}\n{t}") for i, t in enumerate(UNKNOWN)]
    rows += [(3000, None), (3001, ""), (3002, "\n \n"), (3003, "My driving license was under the table."), (1000, "no licence at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, rows, license_scan.fit(docs)


def test_licences_are_found(licences):
    docs, rows, model = licences
    found = [r for r in license_scan.report(docs, model).collect()]
    assert len(found) == len(rows)
    of = {r["doc_id"]: r for r in found if r["n_paragraphs"] != 1 or r["doc_id"] != 1000}
    families = [f for f, some in TEMPLATES.items() for _ in some]
    right = sum(of[1000 + i]["families"] == f for i, f in enumerate(families))
    assert right >= 0.9 * len(families)
    assert all(of[i]["n_predicted"] == 0 for i in range(300))
    assert sum(of[2000 + i]["families"] == "" for i in range(len(UNKNOWN))) >= 0.8 * len(UNKNOWN)
    assert sum(of[2000 + i]["n_unknown"] for i in range(len(UNKNOWN))) >= 0.7 * len(UNKNOWN)
    assert all(of[i]["n_paragraphs"] == 0 for i in (3000, 3001, 3002))
    assert of[3003]["n_confirmed"] == 0


def test_licence_scan_equals_plain_version(licences):
    """All lines scored in memory, without the prefilter."""
    import re

    docs, rows, model = licences
    got = {
        (r["doc_id"], r["i"], r["text_hash"]): (r["family"], r["probability"])
        for r in license_scan.scan(docs, model)[1].collect()
    }
    plain = []
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = [x for x in re.split(r"[\W_]+", line.lower()) if x]
            g = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
            s = np.array(model.intercepts) + sum((np.array(model.weights[x]) for x in g if x in model.weights), np.zeros(len(model.intercepts)))
            p = 1 / np.exp((s - s.max()) / model.temperature).sum()
            family = license_scan.CLASSES[int(s.argmax())]
            if w and family != "none":
                plain.append((doc_id, i, "unknown" if p < license_scan.SURE else family))
    assert sorted((k[0], k[1], v[0]) for k, v in got.items()) == sorted(plain)


def test_licence_scan_runs_no_python(licences):
    docs, _, model = licences
    plan = license_scan.report(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_licences_in_empty_table(licences):
    docs, _, model = licences
    assert license_scan.report(docs.limit(0), model).count() == 0


def test_words_that_recur_are_merged_once(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 40)
    own = sentencepiece_bpe.Encoder(open(PIECES, "rb").read())
    merged, merge = [], own.vocabulary.merge
    own.vocabulary.merge = lambda part: merged.append(part) or merge(part)
    for i in range(400):
        own.encode(f"recurring w{i * 7919}q")
    assert merged.count(sentencepiece_bpe.MARK + "recurring") == 1
    assert len(own.units) <= 40 and len(own.units.older) <= 40


def test_short_and_long_units_are_merged_alike():
    rng = random.Random(3)
    v = sentencepiece_bpe.Vocabulary(open(PIECES, "rb").read())
    letters = "abcdeéthingßz漢" + sentencepiece_bpe.MARK
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    for t in [*texts, *["a" * k for k in range(1, 50)]]:
        assert v._merged(t) == v._merged_long(t)


def test_pieces_are_encoded_in_few_texts(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 50)
    own = token_output.Tokenizer(open(BYTES, "rb").read())
    library, calls = own.library, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    own.library = Counted()
    texts = [" ".join(f"wörd{i * j}, <|endoftext|> 漢{i}!" for j in range(40)) for i in range(30)] + [t or "" for t in ODD]
    found = own.encode(texts) + own.encode(texts[::-1])[::-1]
    for t, ids in zip(texts * 2, found, strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    assert sum(calls) < 400
