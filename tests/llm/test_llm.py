import difflib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import garbled, languages, leak, packing, residue, sentences, truncated, unify


# ---- garbled ---------------------------------------------------------------


@pytest.fixture(scope="module")
def documents():
    """Labelled documents for the letter model, and others that it has not seen."""
    import duckdb

    rows = duckdb.sql("select lang, text from '/root/testdata/sf0.1/documents.parquet' where regexp_matches(lang, '^[a-z]{2}$') and length(text) > 60 order by doc_id").fetchall()
    by = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    return [(k, t) for k, v in by.items() for t in v[:120]], {k: [t for t in v[120:] if t not in set(v[:120])][:40] for k, v in by.items()}


@pytest.fixture(scope="module")
def letters(documents):
    return garbled.Model(documents[0])


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", ["Señal – déjà “vu” naïve café", "Önceki çalışmalardan farklı olarak düştü", "𝒳 ≈ 😀 and বাংলা, ქართული"])
def test_round_trip_of_decoders(wrong, text):
    table = garbled._decode_table(wrong)
    bad = "A plain start. " + "".join(table[b] for b in text.encode())
    assert garbled.repair(bad) == (True, "A plain start. " + text, False)


#: (language, true encoding, wrong decoder)
PAIRS = [
    ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ru", "cp866", "cp1252"), ("ru", "iso8859-5", "latin-1"), ("pl", "cp1250", "cp1252"),
    ("pl", "iso8859-2", "latin-1"), ("tr", "cp1254", "cp1252"), ("fr", "latin-1", "mac_roman"), ("fr", "cp437", "cp1252"), ("de", "cp1252", "cp1251"), ("es", "cp1252", "cp1251"), ("ar", "cp1256", "cp1252"),
    ("zh", "gbk", "latin-1"), ("ja", "shift_jis", "cp1252"), ("ko", "euc_kr", "latin-1"), ("th", "cp874", "latin-1"), ("zh", "utf-8", "cp1252"), ("ru", "utf-8", "cp1251"), ("pl", "utf-8", "mac_roman"),
]


def garble(text, true, wrong):
    table = garbled._decode_table(wrong)
    return "".join(table[b] for b in text.encode(true, "ignore")), text.encode(true, "ignore").decode(true)


def test_all_pairs_on_unseen_documents(documents, letters):
    found = restored = wrong_ones = total = 0
    poor = {}
    for lang, true, wrong in PAIRS:
        hits = n = 0
        for text in documents[1].get(lang, []):
            part = " ".join(text.split()[:60]) if lang not in ("zh", "ja", "th") else text[:200]
            bad, good = garble(part, true, wrong)
            if bad == good or sum(c > "\x7f" for c in good) < 8:
                continue
            is_bad, fixed, lost = letters and garbled.repair(bad, letters)
            n += 1
            hits += is_bad
            units = (lambda t: list(t)) if lang in ("zh", "ja", "th") else str.split
            same = difflib.SequenceMatcher(None, units(fixed), units(good), autojunk=False).ratio()
            restored += is_bad and not lost and same > 0.8
            wrong_ones += is_bad and not lost and same < 0.5 and fixed != bad
        found, total = found + hits, total + n
        if n and hits < 0.9 * n:
            poor[lang, true, wrong] = (hits, n)
    print(found, restored, wrong_ones, total)
    assert total > 300
    assert found >= 0.95 * total, (found, total, poor)
    assert wrong_ones <= 0.02 * total, (wrong_ones, total)
    assert restored >= 0.85 * total, (restored, total, poor)


def test_no_false_alarm_on_clean_texts_with_addresses(documents, letters):
    rng = random.Random(6)
    texts = [t for v in documents[1].values() for t in v]
    parts = [p for t in texts for p in t.split(". ") if len(p) > 20]
    alarms = 0
    for k in range(10_000):
        text = rng.choice(parts) + f" See http://x.org/a?b={k}&c=d?e=f for the data. What?no"
        alarms += garbled.repair(text, letters)[0]
    assert alarms <= 5


def test_other_scripts_are_not_destroyed(letters):
    """Greek and Hebrew are not in the sample: they stay as they are or are restored, but never turn into something else."""
    for text, true in (("Η μελέτη επαναλήφθηκε στην κοιλάδα και η απόδοση αυξήθηκε", "iso8859-7"), ("המחקר חזר על עצמו בעמק והתפוקה עלתה בשליש", "cp1255")):
        bad, good = garble(text, true, "latin-1")
        _, fixed, lost = garbled.repair(bad, letters)
        assert fixed in (bad, good) or lost


def test_twice_and_code_pages(letters):
    once = "Señal “x” naïve".encode().decode("cp1252", "replace").replace("\ufffd", "\x9d")
    table = garbled._decode_table("cp1252")
    assert garbled.repair("".join(table[b] for b in once.encode()))[1] == "Señal “x” naïve"
    russian = "Полученные результаты показывают многое"
    assert garbled.repair(russian.encode("cp1251").decode("latin-1"), letters) == (True, russian, False)
    assert garbled.repair(russian.encode("koi8-r").decode("cp1251"), letters) == (True, russian, False)


@pytest.mark.parametrize("text", [None, "", "plain", "Łucja Ekenóuxt", "CONCLUSÃO: não", "«Наша СССР». Гёте, Сёмга", "Mont–élevé", "Is it? Yes", "日本語のテキスト", "ภาษาไทย", "see http://x.org/a?b=c for the data", "What?no", "a rise of 3 µg at 5 °C"])
def test_proper_text_stays(text, letters):
    assert garbled.repair(text, letters) == (False, text, False)
    assert text is not None and "?" in text or garbled.repair(text) == (False, text, False)


def test_lost(letters):
    assert garbled.repair("M?ridan and caf??-style")[0::2] == (True, True)
    assert garbled.repair("Se\ufffd\ufffdal")[2]
    assert garbled.repair("The caf?s of Paris, t?rrib", letters)[2]


def test_garbled_operator(spark):
    rows = [(1, "NaÃ¯ve", None), (2, "ok", "RenÃ©"), (1, "NaÃ¯ve", None), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string").selectExpr("*", "'x' as col")
    out = sorted((r.id, r.col, r.fixed) for r in garbled.repair_cells(df, "id", ["a", "b"]).collect())
    assert out == [(1, "a", "Naïve"), (1, "a", "Naïve"), (2, "b", "René")]
    assert garbled.repair_cells(df.limit(0), "id", ["a"]).count() == 0


# ---- residue ---------------------------------------------------------------


@pytest.fixture(scope="module")
def index():
    words = "the of and in to is are for a on by at it this that with from as was be or not we which were between site survey access test".split()
    return residue.Index(dict.fromkeys(words, 600), 1000)


REAL = "The cookie notice was accepted by 743 of 924 readers in the study, and the share of those who enabled scripts rose by 4 per cent between the two surveys."


@pytest.mark.parametrize("text", [
    "Please enable JavaScript to view this page.", "{{ article.abstract | safe }}", "TBD", "Error 503: Service Unavailable\nThe requested URL was not found on this server.",
    "Velorite and the yield of bee hives in Oldham - Some Press Forbidden: you do not have permission to read this page", "请启用JavaScript后再访问本页面。",
    "&lt;noscript&gt;This page needs javascript&lt;/noscript&gt;", "Lorem ipsum dolor sit amet, loradirite velit nor corarobyl tempor",
])
def test_residue(index, text):
    assert index.score(text) >= residue.COVERED


@pytest.mark.parametrize("text", [None, "", "N/A", REAL, "A CAPTCHA was shown to 155 users in Holmemere. " + REAL, REAL * 50])
def test_no_residue(index, text):
    assert index.score(text) < residue.COVERED


#: Everyday messages in words of their own, none of which is an exemplar.
HELD_OUT = [
    "Error establishing a database connection", "Your session has timed out; log in once more.", "Whoops, looks like something went wrong.", "This content is not available in your region right now, sorry.",
    "You have reached the limit of requests, please try again in a few minutes.", "Our website is undergoing scheduled maintenance. We will be back shortly.", "The document you requested has been removed or is no longer available.",
    "To continue, please confirm you are not a robot.", "Please turn on JavaScript in your browser settings and refresh the page.", "By using this website you agree to our cookie policy. Accept", "We need to verify your connection before you can proceed. This may take a few seconds.",
    "Your browser is outdated. Please upgrade to view this content.", "Sign in to read the full article", "You do not have access to this content. Log in via your institution.", "An internal error occurred while processing your request. Please contact support.",
    "The requested resource could not be located on the server.", "Nothing found here. Try searching or go to the home page.", "Connection lost. Check your network and reload the page.", "Service temporarily overloaded, retry later", "Failed to load content. Refresh to try again.",
    "Enter the summary of your article here", "Abstract to be added later", "Add your abstract text here (maximum 300 words)", "This is a dummy text, please ignore", "Text coming soon", "Fetching abstract... hold on", "Redirecting, please stand by", "TypeError: undefined is not a function",
    "Exception in thread main java.lang.NullPointerException", "Warning: require(): failed to open stream in /srv/www/index.php on line 12", "Menu Home Journals About us Contact Log in Register", "Share on Twitter Share on Facebook Download PDF Export citation",
    "Sed ut enim ad minim veniam quis nostrud exercitation ullamco", "Diese Seite existiert leider nicht. Zurück zur Startseite", "Bitte schalten Sie JavaScript ein, um diese Seite anzuzeigen", "Cette page n'existe plus. Retour à l'accueil", "La página solicitada no existe", "Запрошенная страница не существует",
    "页面不存在，请返回首页", "Merci de patienter, chargement en cours",
]


def test_residue_in_other_words(index):
    found = [index.score(t) >= residue.COVERED for t in HELD_OUT]
    assert np.mean(found) >= 0.9, [t for t, f in zip(HELD_OUT, found, strict=True) if not f]


@pytest.mark.parametrize("text", [
    "The survey was repeated in the valley and the yield of the wells rose by a third. Access to the server was logged.", "A total of 964 school districts entered the study, of which 198 met the go…",
    "We describe a test of cookie banners. Readers were asked to accept all cookies or to reject them, and 43 per cent did so within two seconds.", "Maintenance of pumps in rural wells: a review of service and repair in 12 districts.",
])
def test_real_texts_with_words_of_messages(index, text):
    assert index.score(text) < residue.COVERED


def test_titles_of_any_length_and_long_markup(index):
    title = "On the yield of bee hives and of wells in the uplands " * 4
    assert index.score(title + "Please enable JavaScript to view this page.") >= residue.COVERED
    assert index.score('<div class="very long markup of a kind" data-name="something else entirely">' * 30 + "Access denied</div>") >= residue.COVERED


def test_residue_operator(spark):
    df = spark.createDataFrame([(1, "Just a moment...", 0.0), (2, REAL, 0.0), (3, None, 0.0)], "id long, t string, coverage double")
    assert [r.id for r in residue.residue_scores(df, "id", "t").collect()] == [1]
    assert residue.residue_scores(df.limit(0), "id", "t").count() == 0


# ---- truncated -------------------------------------------------------------


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = "soil moisture response barley growth river wells study survey record model yield under along between higher".split()
    return [" ".join(" ".join(rng.choices(words, k=rng.randint(6, 14))).capitalize() + "." for _ in range(rng.randint(3, 7))) for _ in range(n)]


def test_truncation_holds_out():
    texts = corpus()
    model = truncated.fit(texts[:300])
    rng = random.Random(3)
    whole = texts[300:]
    cut = [p for t in whole for p in truncated.cuts(t, rng)]
    assert np.mean([model.score(t, False) < 0.5 for t in whole]) > 0.97
    assert np.mean([model.score(t, False) > 0.5 for t in cut]) > 0.9
    assert model.score(whole[0] + "\nKeywords: soil; wells", False) < 0.5
    assert model.score(None, False) == 0 and model.score("  ", False) == 0 and model.score("N/A", True) == 0


def test_truncation_operator(spark):
    texts = corpus(120)
    rows = [(i, "s" if i % 3 else None, t) for i, t in enumerate(texts)] + [(900 + i, "s", t[:95]) for i, t in enumerate(texts[:20]) if t[94] != "."] + [(999, "s", None)]
    df = spark.createDataFrame(rows, "id long, src string, t string").selectExpr("*", "1 as p_truncated")
    out = {r.id for r in truncated.truncation_scores(df, ["id"], "t", "src").collect()}
    assert len([i for i in out if i >= 900]) >= 15 and len([i for i in out if i < 900]) <= 4
    assert truncated.truncation_scores(df.limit(0), ["id"], "t", "src").count() == 0


# ---- unify -----------------------------------------------------------------


@pytest.mark.parametrize(("a", "b"), [("ｔｏｔａｌ", "total"), ("café", "café"), ("a​b\xa0c ", "ab c"), ("Јаsԁаleіgһ in the uplands", "Jasdaleigh in the uplands"), ("각", "각"), ("x‐y − z", "x-y - z"), ("ﬂeet", "fleet")])
def test_same_look(a, b):
    _, skeleton = unify.unified(pa.array([a, b]))
    assert skeleton[0].as_py() == skeleton[1].as_py()


@pytest.mark.parametrize(("a", "b"), [("resume", "résumé"), ("yield 31.6", "yield 32.6"), ("soil l", "soil 1"), ("ı", "i")])
def test_real_differences(a, b):
    _, skeleton = unify.unified(pa.array([a, b]))
    assert skeleton[0].as_py() != skeleton[1].as_py()


def test_forms_against_the_library():
    rng = random.Random(5)
    pool = "aé ｂҖ각ａ̣́ñがﬁ①กำ‍\n" + "нǖ"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", " x "]
    canonical, _ = unify.unified(pa.array(texts, pa.string()))
    for text, got in zip(texts, canonical.to_pylist(), strict=True):
        if text is None:
            assert got is None
        else:
            want = unicodedata.normalize("NFKC", "".join(c for c in text if c != "‍")).strip(" \n")
            assert unicodedata.is_normalized("NFC", got)
            assert got == want or set(text) & set("Җн")  # look-alike letters may move to the script of their text


def test_unify_operator(spark):
    df = spark.createDataFrame([(1, "ｘ"), (2, None), (1, "ｘ")], "id long, t string").selectExpr("*", "'k' as canonical")
    assert sorted((r.id, r.canonical or "") for r in unify.unify(df, ["id"], "t").collect()) == [(1, "x"), (1, "x"), (2, "")]


# ---- sentences -------------------------------------------------------------

SENTENCES = [
    ["At 9 a.m. the probe read 3.5 mV.", "It ended at 6 p.m.", "The end."],
    ["1. Introduction", "The cat sat.", "It ran.", "2. Methods", "We did."],
    ['Prof. M. B. Ost warned that "the yield never settles. It drifts." before the trial.', "Next."],
    ["Er schrieb: „Die Trübung schwankt. Das ist kein Zufall.“", "Am 12. Mai wurden z. B. 9 (vgl. Abb. 2) bzw. 35 mg gemessen."],
    ["В 2003 г. было собрано 724 проб, т. е. почти.", "«Наша. Так бывает».", "В работе."],
    ["審稿人写道：“浊度一直在波动。这并非偶然。”", "与以往不同。", "好！"],
    ["査読者は「空隙率は揺れている。偶然ではない。」と書いた。", "はい。"],
    ['심사자는 "탁도 값이 흔들린다. 우연이 아니다."라고 적었다.', "향후 연구."],
    ["पहले कार्य 25.3 मि.ग्रा. था।", "क्या है?"],
]


def offsets(text):
    r, k, s, e = sentences.sentence_offsets(pa.array([text], pa.string()))
    return [(text[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences(parts):
    if parts[0] == "1. Introduction":
        text = "1. Introduction\nThe cat sat. It ran.\n\n2. Methods\nWe did."
    else:
        text = ("" if parts[0][0] > "　" and parts[0][0] < "가" else " ").join(parts)
    assert offsets(text) == parts


def test_edges_of_sentences():
    assert offsets("") == [] and offsets("  \n ") == []
    assert offsets("no mark at all") == ["no mark at all"]
    assert offsets("ends here.Another one.") == ["ends here.", "Another one."]
    assert offsets("a line\nthat goes on. Next.") == ["a line\nthat goes on.", "Next."]
    assert offsets('An open "quote. It never ends. Yes.') == ['An open "quote.', "It never ends.", "Yes."]
    long = "It was a long day. " * 20_000
    assert len(offsets(long)) == 20_000


def test_transducer_chunks_agree_with_a_plain_run():
    move, emit = sentences.transducer()
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000, 5000):
        stream = rng.integers(0, len(sentences.SYMBOLS), n).astype(np.uint8)
        state, want = sentences.STATES.index("B"), []
        for s in stream:
            want.append(bool(emit[state, s]))
            state = move[state, s]
        assert sentences.run_transducer(stream).tolist() == want


def test_batch_equals_single():
    texts = [" ".join(p) for p in SENTENCES] + [None, "", "x"]
    r, _, s, e = sentences.sentence_offsets(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [t[a:b] for q, a, b in zip(r.tolist(), s.tolist(), e.tolist(), strict=True) if q == i] == (offsets(t) if t else [])


def test_sentence_operator(spark):
    df = spark.createDataFrame([(1, "A cat. A dog."), (2, None), (1, "A cat. A dog.")], "id long, t string").selectExpr("*", "0 as sent_no")
    assert len(sentences.sentences(df, "id", "t").collect()) == 4
    assert sentences.sentences(df.limit(0), "id", "t").count() == 0


# ---- languages -------------------------------------------------------------

TOY = {
    "en": "the survey was repeated in the valley and the yield of the wells rose by a third . ",
    "de": "die untersuchung wurde im tal wiederholt und der ertrag der brunnen stieg um ein drittel . ",
    "ru": "исследование было повторено в долине и урожай колодцев вырос на треть . ",
}


def toy(seed=0, n=60):
    rng = random.Random(seed)
    return [(k, " ".join(rng.sample(v.split(" "), 12) * 3).capitalize() + ".") for k, v in TOY.items() for _ in range(n)]


@pytest.fixture(scope="module")
def net():
    return languages.fit(toy(), steps=60)


def test_gradients_are_right():
    small = languages.Network(["a", "b"], 3)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (5, 3, languages.STRIDE)).astype(np.uint8)
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = rng.integers(0, 2, (5, 3))
    for k in small.p:
        small.p[k] = small.p[k].astype(np.float64)
    _, grad = small.gradients(x, mask, y)
    for name in ("Uf", "cb", "W", "bf"):
        flat = small.p[name].ravel()
        i = int(rng.integers(flat.size))
        keep, step = flat[i], 1e-3
        flat[i] = keep + step
        up, _ = small.gradients(x, mask, y)
        flat[i] = keep - step
        down, _ = small.gradients(x, mask, y)
        flat[i] = keep
        assert grad[name].ravel()[i] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_held_out_language(net):
    found = languages.segments(net, [t for _, t in toy(9, 20)])
    assert np.mean([{s[2] for s in row} == {k} for row, (k, _) in zip(found, toy(9, 20), strict=True)]) > 0.95


def test_mixed_text(net):
    parts = toy(7, 1)
    text = parts[0][1] + " " + parts[2][1]
    assert [s[2] for s in languages.segments(net, [text])[0]] == ["en", "ru"]
    assert languages.segments(net, [""]) == [[]]


def test_language_operator(spark, net):
    df = spark.createDataFrame([(1, toy()[0][1]), (2, None), (3, "N/A"), (4, " ")], "id long, t string").selectExpr("*", "'q' as langs")
    assert [(r.id, r.langs) for r in languages.label_texts(df, ["id"], "t", net).collect()] == [(1, ["en"])]
    assert languages.label_texts(df, ["id"], "t", None).count() == 0
    assert languages.fit([]) is None


# ---- leaks -----------------------------------------------------------------


def test_alignment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(3, 14)), rng.integers(0, 6, rng.integers(3, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        run = np.zeros_like(h)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                h[i, j] = max(0, h[i - 1, j - 1] + (leak.MATCH if same else leak.MISMATCH), h[i - 1, j] + leak.GAP, h[i, j - 1] + leak.GAP)
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        score, _, _, _, longest = leak.align(a, b)
        assert (score, longest) == (h.max(), run.max())


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(vocab, k=30)) for _ in range(6)]
    docs = []
    for i in range(60):
        words = rng.choices(vocab, k=80)
        if i % 2:
            source = items[i % 6].split()
            n = rng.choice([8, 11, 12, 13, 20])
            at = rng.randrange(0, 30 - n + 1)
            words[20 : 20 + n] = [w.upper() for w in source[at : at + n]]
        docs.append((i, " ,".join(words)))
    docs += [(100, None), (101, ""), (1, docs[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as share")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "too short")], "item_id long, text string")
    grams = {(i, tuple(t.split()[k : k + 12])) for i, t in enumerate(items) for k in range(19)}
    want = set()
    for k, t in docs:
        w = leak.words(t)
        seen = {tuple(w[j : j + 12]) for j in range(len(w) - 11)}
        want |= {(k, i) for i, g in grams if g in seen}
    got = {(r.doc_id, r.item_id) for r in leak.leaks(d, "doc_id", "text", q, "item_id", "text").where("longest_run >= 12").collect()}
    assert got == want and want
    assert leak.leaks(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    assert leak.leaks(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0


def test_edited_copies_are_aligned(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    items = [rng.choices(vocab, k=60) for _ in range(20)]
    docs = []
    for k, item in enumerate(items):
        copy = [f"new{i}" if i % 10 == 5 else w for i, w in enumerate(item)]  # one word changed in every ten
        docs.append((k, " ".join(rng.choices(vocab, k=50) + copy + rng.choices(vocab, k=50))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leak.leaks(d, "doc_id", "text", q, "item_id", "text").collect()}
    assert set(got) == {(k, k) for k in range(20)}
    assert all(r.n_words >= 54 and r.longest_run == 9 and r.share >= 0.8 for r in got.values())


def test_no_alignment_outside_the_stretches():
    rng = np.random.default_rng(5)
    for _ in range(100):
        items = [rng.integers(0, 9, rng.integers(2, 20)).astype(np.uint64) for _ in range(4)]
        doc, chosen = rng.integers(0, 14, rng.integers(1, 60)).astype(np.uint64), np.array([0, 1, 3])
        whole = [leak.align(items[i], doc)[0] for i in chosen]
        least = np.array(whole) - rng.integers(0, 3, 3)
        found = leak.stretches(doc, chosen, least, leak.Holders(items, 1), leak.Holders(items, 2), 4)
        assert [max((leak.align(items[chosen[k]], doc[lo:hi])[0] for k, lo, hi in found if k == n), default=0) for n in range(3)] == whole


# ---- packing ---------------------------------------------------------------


def test_packing_keeps_all_and_fits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 3, 40, 100, 101, 999])) for i in range(300)]
    out = packing.pack_texts(spark.createDataFrame(rows, "id long, n_tokens long").selectExpr("*", "0 as capacity"), "id", [50, 100]).toPandas()
    out["n"] = out.token_end - out.token_start
    assert out.groupby("id").n.sum().to_dict() == {i: n for i, n in rows if n}
    boxes = out.groupby("container").agg(n=("n", "sum"), capacity=("capacity", "first"), kinds=("capacity", "nunique"))
    assert (boxes.n <= boxes.capacity).all() and (boxes.kinds == 1).all()
    whole = out[out.id.map(dict(rows)) <= 100]
    assert (whole.groupby("id").size() == 1).all()
    assert boxes.n.sum() / boxes.capacity.sum() > 0.9
    for _, box in out.sort_values("slot_start").groupby("container"):
        assert box.slot_start.tolist() == [0, *np.cumsum(box.n.to_numpy())[:-1].tolist()]
    with pytest.raises(ValueError):
        packing.pack_texts(spark.createDataFrame(rows, "id long, n_tokens long"), "id", [0])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.n_tokens for r in packing.token_counts(df, "id", "t").collect()}
    assert got[2] == got[3] == 0 and got[1] == len(packing.encoder().encode_ordinary("hello world"))


# ---- garbled cells -----------------------------------------------------------


def test_escaped_cells():
    cell = '[{"name": "Nikolai Rosad\\u00c3\\u00bcra"}]'
    assert garbled.repair(cell) == (True, '[{"name": "Nikolai Rosadüra"}]', False)
    proper = '[{"name": "Jos\\u00e9 \\u0141uk"}]'
    assert garbled.repair(proper) == (False, proper, False)


def test_twice_garbled_chinese():
    table = garbled._decode_table("cp1252")
    bad = "本研究采用混合线性模型测量了地区样本的骨密度"
    for _ in range(2):
        bad = "".join(table[b] for b in bad.encode())
    assert garbled.repair(bad) == (True, "本研究采用混合线性模型测量了地区样本的骨密度", False)
