import random

import pytest
from pyspark.sql import functions as F

from tagloom.llm.mojibake import PAIRS, SENTENCES, fit, garble, garbled_documents, tokens, ungarble

CLEAN = {
    "de": "Die größere Hälfte der Geräte läuft übermäßig heiß, während die Lüfter schließlich wieder kühlen. Für Prüfungen genügen fünf Blöcke.",
    "fr": "La mémoire du contrôleur a été réparée après l’été, déjà très tôt. Où sont les données périmées du château ?",
    "es": "El próximo año la sesión más rápida leerá el tamaño máximo según la línea. ¿Qué pasó después de la revisión?",
    "pt": "A configuração do botão não começou às três; a função de retenção avançou até amanhã. NÃO É A AÇÃO.",
    "pl": "Główny dysk włączył się później niż zwykle, a błędny znacznik zastąpił większość półek. Źle się dzieje, żółć!",
    "ru": "Старый контроллер пропустил вечерний отчёт и удалил последнюю запись раньше срока. ВНИМАНИЕ: объём журнала растёт!",
    "ja": "古いスナップショットは静かに欠けた行を移した。夜間の点検は予定どおりしきい値を確認した。",
    "en": "The sensor’s reading sat at 41 °C — two degrees above the “usual” mean… it cost €40 or £30, i.e. ½ of it.",
}
MADE = [
    ("de", ("utf-8", "cp1252", 1)), ("fr", ("utf-8", "cp1252", 1)), ("es", ("utf-8", "latin-1", 1)), ("pt", ("utf-8", "cp1252", 2)), ("pl", ("utf-8", "cp1250", 1)), ("ru", ("utf-8", "cp1251", 1)), ("ru", ("utf-8", "cp1252", 1)), ("de", ("utf-8", "cp437", 1)),
    ("en", ("utf-8", "mac_roman", 1)), ("en", ("utf-8", "cp1252", 1)), ("de", ("cp1252", "cp437", 1)), ("fr", ("cp1252", "mac_roman", 1)), ("es", ("cp1252", "cp850", 1)), ("ru", ("cp1251", "cp1252", 1)), ("ru", ("koi8-r", "cp1251", 1)), ("ru", ("cp1251", "koi8-r", 1)),
    ("pl", ("cp1250", "cp1252", 1)), ("ja", ("euc_jp", "cp1252", 1)), ("ja", ("cp932", "cp1252", 1)), ("ja", ("utf-8", "cp1252", 1)),
]


@pytest.fixture(scope="module")
def model():
    return fit([])


def label(model, text):
    at, toks = tokens(text)
    return model.repair(text, at, toks, model.label([toks])[0])


@pytest.mark.parametrize("lang", sorted(CLEAN))
def test_clean_text_stays(model, lang):
    assert label(model, CLEAN[lang]) == (CLEAN[lang], [])


@pytest.mark.parametrize("lang,pair", MADE)
def test_whole_text_is_restored(model, lang, pair):
    src = CLEAN[lang].encode(pair[0], "ignore").decode(pair[0])
    bad = garble(src, pair)
    new, found = label(model, bad)
    assert found and new == src


@pytest.mark.parametrize("lang,pair", [x for x in MADE if x[1][0] == "utf-8"])
def test_a_part_within_clean_text(model, lang, pair):
    bad = f"{CLEAN[lang]} {garble(CLEAN[lang], pair)} {CLEAN[lang]}"
    new, found = label(model, bad)
    assert new == " ".join([CLEAN[lang]] * 3) and found


def test_inverse_undoes_every_pair():
    for pair in PAIRS:
        for s in SENTENCES:
            src = s.encode(pair[0], "ignore").decode(pair[0])
            bad = garble(src, pair)
            if "�" not in bad:
                back = ungarble(bad, pair)
                assert back is None or back == src or pair[1] in ("gbk", "cp932", "mac_roman", "cp437", "cp850")


def test_lost_characters_are_listed_but_stay(model):
    t = "Der Z�hler best�tigt die K�hlung"
    new, found = label(model, t)
    assert new == t and found and not found[0][3]


def test_documents(spark):
    rng = random.Random(5)
    rows, bad = [], set()
    for i in range(200):
        lang = rng.choice(sorted(CLEAN))
        text = CLEAN[lang]
        if i % 4 == 0:
            text = f"{CLEAN['en']} {garble(text, ('utf-8', 'cp1252', 1))}"
            bad.add(i)
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1002, "plain ASCII"), (1003, "x" * 300000 + garble("größere Lüfter", ("utf-8", "cp1252", 1))), (0, rows[0][1])]
    bad.add(1003)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_spans", F.lit("clash"))
    got = garbled_documents(df).collect()
    assert {r.doc_id for r in got} == bad and sum(r.doc_id == 0 for r in got) == 2
    assert all(r.restorable for r in got) and next(r for r in got if r.doc_id == 1003).text == "x" * 300000 + "größere Lüfter"
    assert garbled_documents(df.limit(0)).count() == 0


def test_recall_on_held_out_documents(spark):
    """Fitted on one half of the corpus' documents, the other half garbled by every pair that suits its language."""
    import re
    from collections import Counter

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text", F.lower("lang").alias("lang")).collect()
    some = [r for r in rows if not r.text.isascii() and r.lang in CLEAN]
    fitted = fit(Counter(c for r in some if r.doc_id % 2 for c in re.findall(r"[^\s]{0,12}[^\x00-\x7F][^\s]{0,24}", r.text)).most_common(4000))
    held = [r for r in some if not r.doc_id % 2]
    paths = fitted.label([tokens(r.text)[1] for r in held])
    clean = [r for r, p in zip(held, paths) if not p.any()]
    for lang, pair in MADE:
        texts = [garble(r.text.encode(pair[0], "ignore").decode(pair[0]), pair) for r in clean if r.lang == lang and sum(not c.isascii() for c in r.text) > 4]
        both = [tokens(t) for t in texts]
        found = sum(bool(fitted.repair(t, *b, p)[1]) for t, b, p in zip(texts, both, fitted.label([b[1] for b in both])))
        assert len(texts) >= 5 and found >= 0.9 * len(texts), (lang, pair)


def test_seed_sentences_are_not_from_the_corpus(spark):
    from tagloom.llm.mojibake import SENTENCES

    whole = "\n".join(r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").collect())
    for s in SENTENCES[:-1]:
        w = s.split()
        assert not [1 for i in range(len(w) - 2) if " ".join(w[i : i + 3]) in whole]


def test_samples_are_bounded_and_alike(spark, monkeypatch):
    from tagloom.llm import mojibake

    monkeypatch.setattr(mojibake, "SAMPLE_DOCS", 50)
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("größe "), F.col("id")).alias("text"))
    assert mojibake.sample_chunks(df) == [("größe", 50)] and mojibake.sample_chunks(df.limit(0)) == []


def test_a_few_words_once_decoded(model):
    """Whether they were decoded once or twice shows in the inverse, not in the labels."""
    t = f"{CLEAN['de']} {garble('Das Laufwerk zählt vier ältere Kopien', ('utf-8', 'cp1252', 1))}"
    assert label(model, t)[0] == f"{CLEAN['de']} Das Laufwerk zählt vier ältere Kopien"


# The first article of the declaration in languages that neither the corpus nor most of the seeds have.
OTHERS = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza. Perché la città è più bella però così.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, testvéri szellemben kell hogy viseltessenek.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है।",
}


def test_clean_text_of_other_languages_stays(spark):
    import re
    from collections import Counter

    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").collect()]
    fitted = fit(Counter(c for t in texts for c in re.findall(r"[^\s]{0,12}[^\x00-\x7F][^\s]{0,24}", t)).most_common(4000))
    assert {k: label(fitted, t)[1] for k, t in OTHERS.items()} == {k: [] for k in OTHERS}


def test_frequent_words_are_clean_whatever_they_might_be():
    """A word that a single-byte pair could have made stays in the fit if what it would have been is not there."""
    found = lambda chunks: label(fit(chunks), "Он удалил пустые блоки ночью")[1]
    russian = [(w, 40) for w in ("Диск", "удалил", "блоки", "ночью", "отчёт", "раньше", "срока")]
    assert found([*russian, ("пустые", 500)]) == []


ICELANDIC = "Þetta er ekki það sem ég átti við"  # neither seeds nor corpus have it


def test_documents_of_any_length_are_in_the_fit(spark, model):
    """Words that the documents show to be clean, all of which are longer than 20,000 characters."""
    df = spark.createDataFrame([(i, "x " * 10_001 + ICELANDIC) for i in range(30)], "doc_id bigint, text string")
    assert label(model, ICELANDIC)[1] and garbled_documents(df).collect() == []


def test_no_bound_on_documents_or_pieces_of_the_fit(spark, monkeypatch):
    """Words in a tenth of the documents, which are not among the most frequent ones."""
    from tagloom.llm import mojibake

    monkeypatch.setattr(mojibake, "SAMPLE_CHUNKS", 6)
    df = spark.range(300).selectExpr("id AS doc_id", f"if(id % 10 = 0, '{ICELANDIC}', 'Die größere Hälfte läuft übermäßig heiß, schließlich kühlen fünf Lüfter für später') AS text")
    assert garbled_documents(df).collect() == []


def test_the_fit_on_documents_is_the_fit_on_all_their_pieces(spark):
    import re
    from collections import Counter

    from tagloom.llm.mojibake import fit_documents

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r[0] for r in df.where("text is not null").select("text").collect() if not r[0].isascii()]
    pieces = Counter(c for t in texts for c in re.findall(r"[^\s]{0,12}[^\x00-\x7F][^\s]{0,24}", t, re.ASCII))
    whole, got = fit(list(pieces.items()), len(texts)), fit_documents(df.repartition(7))
    assert got.pairs == whole.pairs and [t.pair for t in got.tables] == [t.pair for t in whole.tables]


def test_a_repeated_corpus_gives_the_same_fit():
    pieces = [("Диск", 4000), ("удалил", 40), ("größe", 900), ("schön", 1), ("удалил".encode().decode("cp1251"), 3), ("пустые", 7)]
    one, many = fit(pieces, 6000), fit([(c, 64 * n) for c, n in pieces], 64 * 6000)
    assert one.pairs == many.pairs and [t.pair for t in one.tables] == [t.pair for t in many.tables]


def test_counts_by_neighbours_are_those_of_whole_pieces():
    from tagloom.llm.mojibake import Table, _tables, count_neighbours, spelt_out

    pieces = [w for s in SENTENCES for w in s.split(" ") if not w.isascii()] + ["5€/Ω~日本\\語", "a’b—ü、Ж\u0081", "naïve😀é", "é"]
    sums = {}
    count_neighbours([(w, i % 9 + 1) for i, w in enumerate(pieces)], sums)
    texts = [f" {w} " for w in pieces]
    whole = _tables([tokens(t)[1] for t in texts], texts, [i % 9 + 1 for i in range(len(texts))], [Table() for _ in range(len(PAIRS) + 1)])
    assert spelt_out(sums) == {(i, *k): n for i, t in enumerate(whole) for k, n in t.pair.items()}
