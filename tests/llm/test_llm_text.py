"""Problems 3, 5, 8, 9 and 10: round trips, fixtures and held-out accuracy."""

from __future__ import annotations

import base64
import random
import unicodedata

import pytest

from sparkweave.llm import p3_encoding, p5_boilerplate, p8_tokenize, p9_leaks, p10_language

CLEAN = [
    "Die größere Mühle prüft die Müdigkeit", "L'infirmière révèle l'activité à jeun", "El señor acompaña la absorción, «según» él", "A equipa de investigação não muda o açúcar",
    "Спокойный сон меняет уровень сахара", "ПРАВИЛА · КОНФИДЕНЦИАЛЬНОСТЬ", "“smaller leeks”, it’s said — 5 µg at 37 °C", "© 2021 Søren. Tous droits réservés. IMPRESSÃO", "plain ascii", "価格は 5 €", "Ähnlich Âge À Ó Í",
]


def test_clean_text_stays():
    r = p3_encoding.Repair()
    for t in CLEAN:
        assert r.text(t) == (t, 0), t


@pytest.mark.parametrize("legacy", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1254"])
def test_round_trips(legacy):
    r = p3_encoding.Repair()
    for t in CLEAN[:5]:
        try:
            bad = t.encode().decode(legacy)
        except UnicodeDecodeError:
            continue
        new, n = r.text(bad)
        assert n and new == t, bad


def test_nested_and_lost():
    r = p3_encoding.Repair()
    twice = "révèle".encode().decode("cp1252").encode().decode("cp1252")
    assert r.text(twice)[0] == "révèle"
    assert r.text("год: " + "Новая лаборатория меняет вкус".encode("koi8-r").decode("cp1251"))[0] == "год: Новая лаборатория меняет вкус"
    assert r.text("Спокойный сон меняет вкус".encode("cp1251").decode("cp1252"))[0] == "Спокойный сон меняет вкус"
    assert r.text("caf� au lait") == ("caf� au lait", 1)
    assert r.text("") == ("", 0)


def test_repaired_frame(spark):
    df = spark.createDataFrame([(1, "cafÃ©"), (1, "cafÃ©"), (2, "café"), (3, None), (4, ""), (None, "fÃ¼r")], "uid long, text string").selectExpr("*", "'x' as id", "1 as n_garbled")
    assert sorted((r.uid or 0, r.text) for r in p3_encoding.repaired(df.select("uid", "text").distinct(), "uid", "text").collect()) == [(0, "für"), (1, "café")]
    assert p3_encoding.repaired(df.limit(0), "uid", "text").count() == 0


def test_frames(spark):
    page = ["Home | News | Contact", "By the Kelp desk", "How kelp and rye went along with sleep", "Cookies made of kelp were eaten.", "Method", "Share kelp with rye, and sleep soon follows.", "150 ml pickled pears",
            "© 2020 Kelp. All rights reserved.", "Read more: Why rye slept on and on", "What rye can tell us about the sleep of kelp"]
    assert p5_boilerplate.places(page, True) == [0, 1, 7, 8, 9]
    assert p5_boilerplate.kind("Lea tambiÃ©n: algo") != p5_boilerplate.FRAME and p5_boilerplate.kind("Lea también: algo") == p5_boilerplate.FRAME
    rows = [(i, f"http://kelp.example/{i}", "\n".join([f"zzz unknown strip {i}", *page[2:4], f"It was said {i} times that rye sleeps.", "zzq end strip"])) for i in range(6)]
    rows += rows[:2] + [(50, None, "Menu\nIt is so."), (51, "http://kelp.example/z", None), (None, "u", "Menu"), (52, "http://kelp.example/y", "")]
    df = spark.createDataFrame(rows, "uid long, url string, text string").selectExpr("*", "'x' as site", "1 as line_no").select("uid", "url", "text")
    got = {tuple(r) for r in p5_boilerplate.boilerplate(df).collect()}
    assert (50, 0) in got and all((i, 4) in got and (i, 3) not in got for i in range(6))
    w = p5_boilerplate.spelled_wrappers(df).collect()
    assert [r.pages for r in w] == [7] and "zzq end strip?" in w[0].wrapper.split("\n")
    assert p5_boilerplate.boilerplate(df.limit(0)).count() == 0


def test_unlisted_frames(spark):
    """Sentences of the frame that no list of phrases has, found by the site's wrapper; those within the text and titles of one form stay."""
    consent, legal, figures = "Reading on here lets us leave small crumbs behind.", "Nothing on these sheets stands in for a visit to the ward.", "3 crumbs are left by each visit."
    closing, counted = "So ended another week of the long trial.", "Every portion was weighed twice in the kitchen."
    rows = [(i, f"http://kelp.example/{i}", "\n".join([consent, f"Rye number {'abcdefghijkl'[i]} and how it slept", f"It was said that rye {i} sleeps.", counted, f"Nobody asked barley {'abcdefghijkl'[i]} about it.", legal, figures])) for i in range(12)]
    rows += [(100 + i, f"http://rye.example/{i}", "\n".join([f"Ostraby: the {'abcdefghijkl'[i // 12]}{'abcdefghijkl'[i % 12]} harvest and its twin" if i < 4 else f"Harvest {'abcdefghijkl'[i // 12]}{'abcdefghijkl'[i % 12]}", f"Plain text {'abcdefghijkl'[i // 12]}{'abcdefghijkl'[i % 12]} is here.", *[closing] * (i < 2)])) for i in range(40)]
    assert not {p5_boilerplate.kind(x) for x in (consent, legal, figures, closing, counted)} & {p5_boilerplate.FRAME}
    df = spark.createDataFrame(rows, "uid long, url string, text string")
    got = {tuple(r) for r in p5_boilerplate.boilerplate(df).collect()}
    assert got == {(i, k) for i in range(12) for k in (0, 5, 6)}


def test_slots_of_wrappers(spark):
    """Lines of the frame that share only a part, by the site's wrapper alone."""
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03}")
    page = lambda i: ["Oats | Kelp | Rye and bran", f"Onward: how {name(i)} went along with {name(i + 9)}", f"How kelp {name(i)} went along with sleep", f"It was said of {name(i)} that rye sleeps.", "Method", f"Then {name(i)} was left out of the sums.", f"{i} nods", f"Those of {name(i)} slept on.", f"All of rye {name(i + 5)} in a nutshell ({i} notes)", f"We of the mill leave {name(i)} crumbs here.", "zzq end"]
    rows = [(i, f"http://kelp.example/{i}", "\n".join(x for k, x in enumerate(page(i)) if k != 4 or i % 9 == 0)) for i in range(60)]
    got = {(r.uid, rows[r.uid][2].split("\n")[r.line_no]) for r in p5_boilerplate.frame_lines(spark.createDataFrame(rows, "uid long, url string, text string")).filter("by_wrapper").collect()}
    assert got == {(i, page(i)[k]) for i in range(60) for k in (0, 1, 6, 8, 9, 10)}
    assert p5_boilerplate.Part([]).wrapper() == [] and not p5_boilerplate.forms("  ", "x")


def test_places_of_wrappers(spark):
    """The same line in two places of a wrapper, and lines of few pages between the frame's: told by alignment."""
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03}")
    rare = lambda i: i in (20, 40)
    page = lambda i: ["Zzq strip", *["Crumbs now"] * rare(i), "Oat lore", "Rye lore", f"How kelp {name(i)} went along with sleep", f"It was said of {name(i)} that rye sleeps.", *["Oat lore"] * (i % 8 == 0),
            f"Then {name(i)} was left out of the sums.", *["Husks too"] * rare(i), f"Those of {name(i)} slept on and on.", "Zzq end", *["Chaff now"] * rare(i), "Zzq rim"]
    rows = [(i, f"http://kelp.example/{i}", "\n".join(page(i))) for i in range(64)]
    assert not any(p5_boilerplate.places(page(i), True) for i in range(64))
    got = {(r.uid, r.line_no) for r in p5_boilerplate.frame_lines(spark.createDataFrame(rows, "uid long, url string, text string")).filter("by_wrapper").collect()}
    frame, text = {"Zzq strip", "Crumbs now", "Rye lore", "Zzq end", "Chaff now", "Zzq rim"}, ["Oat lore"]
    assert got == {(i, k) for i in range(64) for k, x in enumerate(page(i)) if x in frame or x in text and k < 3}
    # a copy has no text of its own: what it alone shares with a page isn't taken for the frame's
    strip, bran, rim = (p5_boilerplate.named("kelp.example", x) for x in ("zzq strip", "bran", "zzq rim"))
    found = p5_boilerplate.Matcher([[strip, 64, 0, 64, 0, 1, 1], [bran, 2, 0, 2, 0, 1, 1], [rim, 64, 0, 64, 0, 1, 1]], 64)
    copy, own = [((t,), False, False) for t in (strip, bran, rim)], ((1 << 40,), True, True)
    assert found.lines(copy) == [True, False, True] and found.lines([*copy, own]) == [True, True, True, False]


def _encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{p8_tokenize.TOKENIZERS}/{p8_tokenize.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p8_tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens(spark):
    enc, rng = _encoding(), random.Random(5)
    texts = ["", " ", "\n\n \t", "Hello  world's end…", "<|endoftext|> is text", "寒い季節に、静かな", "👩‍🔬 ½ ⅓", "aaaa" * 40, "１２３ ٣ x²", "é​﻿ ü", "x\x1c\x85y  z "]
    letters = "ab Zé·'’ts\n\t0９寒Я😀_- "
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (0, "")], "doc_id long, text string").selectExpr("*", "1 as word", "2 as ids")
    rows = p8_tokenize.token_ids(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in rows.collect()}
    assert got.pop(900) == [] and got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in p8_tokenize.decode_ids(rows, "ids").collect()}
    assert all(back[i] == t for i, t in enumerate(texts))
    assert p8_tokenize.token_ids(df.limit(0), "doc_id", "text").count() == 0
    # with few words put in place the others go through the join
    for head in (30, 0):
        assert {r.doc_id: r.ids for r in p8_tokenize.token_ids(df, "doc_id", "text", head=head).collect() if r.ids} == {i: ids for i, ids in got.items() if ids}


ITEMS = [(i, f"Question {i}: in the {n} kitchens, how much {a} {b} did each of the {i + 90} households keep back for the {c}? Answer: {i + 7} grams, because {c} came before {d} and the cook of {n} trusted no {b}.")
         for i, (n, a, b, c, d) in enumerate([("Varvim", "modest", "barley", "sample", "tinnitus"), ("Famles", "rural", "squash", "ward", "glaucoma"), ("Kotbuv", "early", "lentil", "fiddle", "marrow")])]


def test_leaks(spark):
    pad = "The weather stayed as it was and nobody thought much of it at the time of the year. "
    a, b = ITEMS[0][1], ITEMS[1][1]
    docs = [(1, pad + a), (2, pad * 3 + a.upper().replace(" ", "\n").replace(",", "")), (3, a.replace("modest", "steady").replace("each", "any")), (4, pad + " ".join(b.split()[8:22]) + ". " + pad), (5, pad + " ".join(b.split()[8:15])),
            (6, a.replace("Varvim", "Other").replace("barley", "oats").replace("modest", "calm").replace("sample", "trip").replace("tinnitus", "rust").replace("90", "12").replace("7", "3")), (7, None), (8, ""), (1, pad + a), (9, a.split("? ")[0] + "? " + pad + a.split("? ")[1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item")
    i = spark.createDataFrame([*ITEMS, ITEMS[0], (70, None), (71, " ")], "item_id long, text string")
    rows = p9_leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 0), (2, 0), (3, 0), (4, 1), (9, 0)]
    assert all(r.question_share == r.answer_share == 1 for r in rows if r.doc_id in (1, 2)) and [r.answer_share < 0.5 < r.question_share for r in rows if r.doc_id == 4] == [True]
    # more items than an index may have are searched in parts
    assert sorted((r.doc_id, r.item_id) for r in p9_leaks.leaks(d, "doc_id", "text", i, "item_id", "text", part_items=2).collect()) == [(1, 0), (2, 0), (3, 0), (4, 1), (9, 0)]
    assert p9_leaks.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert p9_leaks.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    plain = lambda t: unicodedata.normalize("NFKD", t)
    assert p9_leaks.words_of("Café's—X") == [w for w in ["cafes", "x"]] and plain("é") != "é"


def test_leaks_of_stock_words_and_parted_sentences():
    stem = "which of the following is the most likely next step for the person who was described above"
    items = [(0, stem), *[(k, f"{stem} number {k} with kelp{k} and rye{k}") for k in range(1, 301)], (999, "Ola kept nine grey snails here. Her aunt sold six of them. None was ever seen again by Ola.")]
    index, pad = p9_leaks.Index(items), "The weather stayed as it was and nobody thought much of it at the time of the year. " * 3
    texts = [pad + stem + " " + pad, pad, f"Ola kept nine grey snails here. {pad} Her aunt sold six of them. {pad}", f"{pad} Her aunt sold six of them. {pad} Ola kept nine grey snails here.", f"{pad * 9}{items[7][1]} {pad * 9}"]
    assert {(d, i) for d, i, *_ in p9_leaks._search(index, texts)} == {(0, 0), (2, 999), (4, 7), (4, 0)}
    assert not list(p9_leaks._search(p9_leaks.Index([(1, "kelp")]), ["rye and barley", ""])) and list(p9_leaks._search(p9_leaks.Index([(1, "kelp")]), ["rye and kelp"]))


LINES = {
    "en": "The older group asked whether barley was linked to sleep {}|About half of the people said little about the evening meal {}|They logged what was eaten in the home kitchen {}",
    "de": "Die ältere Gruppe prüft den Blutdruck am Morgen nach der Küche {}|Das Gemüse vom Markt verbessert den Schlaf auf dem Land {}|Der zweite Fragebogen erfasst die Ergebnisse {}",
    "fr": "Le groupe le plus âgé décrit le goût des légumes à la campagne {}|La cantine du village ralentit la fatigue des bénévoles {}|Cette étude confirme les résultats déjà publiés {}",
    "es": "El segundo cuestionario reduce el cansancio de los voluntarios {}|La harina de avena cambia la salud de los gemelos {}|El equipo de investigación explica el sabor {}",
    "ru": "Старшая группа меняет вкус овощей вопреки ожиданиям {}|Второй опросник снижает уровень сахара {}|Соседняя пекарня улучшает аппетит после лечения {}",
    "ja": "寒い季節に、高齢の参加者は静かに疲れを減らした{}|多くの場合、研究班はわずかに血糖を測った{}|夕食の前に、大麦の粉は食欲を支えた{}",
}


def test_languages(spark):
    names = ["Anna", "Bruno", "Zoë", "Ivo", "Elif", "Noor", "Pavel", "Yuki"]
    docs = [(n * 10 + k, "\n".join(x.format(names[(k + j) % 8]) for j, x in enumerate(t.split("|"))), lang) for n, (lang, t) in enumerate(LINES.items()) for k in range(8)]
    swap = [(900, docs[0][1] + "\n" + docs[8][1].split("\n")[0] + "\n12 | 13", "EN-gb"), (901, docs[16][1], "German"), (902, docs[24][1], None), (903, None, "en"), (904, "1 2 3\n", "en"), (905, "", None), (906, docs[32][1], "xx"), (900, docs[0][1] + "\n" + docs[8][1].split("\n")[0] + "\n12 | 13", "EN-gb")]
    df = spark.createDataFrame(docs + swap, "doc_id long, text string, lang string").selectExpr("*", "1 as line_no", "'q' as label")
    rows = p10_language.languages(df, "doc_id", "text", "lang").filter("line_no >= 0 or not label_right").collect()
    assert sorted((r.doc_id, r.line_no, r.lang) for r in rows) == [(900, 3, "de"), (901, -1, "fr"), (902, -1, "es"), (906, -1, "ru")]
    assert p10_language.languages(df.limit(0), "doc_id", "text", "lang").count() == 0
    # a line in a language that the model doesn't know comes out, marked
    strange = spark.createDataFrame([(1, docs[0][1] + "\nKaksi vanhaa leipuria kantoi jauhoja myllyltä kotiin", "en")], "doc_id long, text string, lang string")
    known = p10_language.fit(df, "text", "lang")
    odd = p10_language.languages(strange, "doc_id", "text", "lang", known).filter("line_no = 3").collect()
    assert len(odd) <= 1 and all(r.ambiguous == (r.confidence < p10_language.CONFIDENT) for r in odd)
    code = p10_language.codewords()
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 5
