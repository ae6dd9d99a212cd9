import pytest

from leafmill.llm import sentences
from leafmill.sources.tables import table

SENTENCES = {
    "en": ["The valve opens at 7 p.m. sharp.", "Dr. Velmora and Prof. P. Lum saw Fig. 4, cf. No. 37.", "pH values rose by 3.14 kg!", "“Does it hold?” asked F. V. Pellgath of the group.", "She said: “It holds.”", "(The orbit is described in App. B.)", "It waited ... and then closed."],
    "de": ["Am 3. März kühlte der Sensor den Fluss um 82,5 Prozent.", "Der 2. Verteiler veränderte ca. 1.3 kg.", "„Der Puffer veränderte nichts“, schrieb Dr. Heskbeld, „und der Rand auch nicht.“", "Laut Nr. 4 und Abb. 7 ordnete der Rand den Abschnitt, d. h. den groben."],
    "fr": ["Pourquoi le jardin améliore-t-il le port\xa0?", "N. Sorvmora note\xa0: «\xa0Le quai limite le registre.\xa0»", "M. Dravgath remplace le cristal, cf. fig. 140 et p. 60."],
    "es": ["¿Por qué reduce el cálculo al horno?", "¡El muelle sustituye otra vez el ensayo!", "El Sr. Pell explica el vector, véase pág. 4 y fig. 30."],
    "ru": ["В 2007 г. C. E. Tartuun описал фильтр, т. е. прочный результат.", "И снова лес опроверг порог!", "«вектор усилил пульт», — отметил V. Heskphane."],
    "zh": ["为什么附录推迟了章节？", "“缓冲区保存了阀门吗？”Dravimer问道。", "据Zanlowe说：“材料超过了港口。”", "（见第709节。）"],
    "ja": ["「語料が図表を検査した。」とUlthphaneは述べた。", "誤差は3.3から0.2へ下がった。"],
    "hi": ["पटल अभिलेख को क्यों दोहराता है?", "“क्या ढाँचा दस्तावेज़ को रोकता है?” Lumgath ने पूछा।", "1987 तक पदार्थ ने आधार को नहीं देखा।"],
    "ar": ["قال د. Yarkska: «هل أكّد الحساب الحامل؟» ثم أخّر المعدن.", "لماذا فصل القناة المحرك؟"],
    "th": ["เราพบร่าง 0.904 กิโลกรัมในวัสดุ", "มอเตอร์ประจำปีเติมเต็มผลึก"],
}
JOIN = {"zh": "", "ja": ""}


@pytest.fixture(scope="module")
def splitter(spark, tables):
    return sentences.fit(sentences.prose(table(spark, tables, "blocks"), "block_type"), "block_row", "text")


def units(splitter, text):
    ends = splitter.ends(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("lang", SENTENCES)
def test_languages(splitter, lang):
    want = SENTENCES[lang]
    for _ in range(2):
        assert units(splitter, JOIN.get(lang, " ").join(want)) == want
        want = want[::-1]


def test_edges(splitter):
    assert splitter.ends(None) == [] and splitter.ends("") == [] and splitter.ends(" \n ") == []
    assert units(splitter, "  no mark here  ") == ["no mark here"]
    assert splitter.ends("  One.  ") == [6]
    assert units(splitter, "1. The first item.\n2. The second item.") == ["1. The first item.", "2. The second item."]
    assert units(splitter, "A heading\n\nThe text goes on.") == ["A heading", "The text goes on."]
    assert units(splitter, "The wrapped\nline ends. The next one\nis here.") == ["The wrapped\nline ends.", "The next one\nis here."]
    long = "The pump held. " * 20_000
    assert len(splitter.ends(long)) == 20_000


def test_held_out_accuracy(spark, tables):
    """Trained on half of the blocks, the classifier finds the reliable places of the other half."""
    texts = sorted(r.text for r in sentences.prose(table(spark, tables, "blocks"), "block_type").where("text is not null").select("text").distinct().collect())
    model = sentences.train(texts[::2])
    rows = sentences.labelled([t.strip() for t in texts[1::2] if t.strip()], model.begins)
    right = sum(n for (c, label), n in rows.items() if model.decide(c) == bool(label))
    assert right / sum(rows.values()) > 0.99


def test_joins_of_held_out_blocks(spark, tables):
    """Ends that no rule labelled: blocks that take no part in training are joined in pairs; the ends of each must be those it has alone, and the seam."""
    texts = sorted(r.text.strip() for r in sentences.prose(table(spark, tables, "blocks"), "block_type").where("text is not null").select("text").distinct().collect())
    model = sentences.train(texts[::2])
    held = [t for t in texts[1::2] if t and t[-1] in sentences.MARKS and t[0].isupper()]
    right = sum(len(a) in model.ends(f"{a} {b}") for a, b in zip(held, held[7:]))
    assert len(held) > 60 and right > 0.97 * (len(held) - 7)


def test_short_cuts_change_nothing(spark, tables, monkeypatch):
    """The most frequent neighbourhoods are told without looking closer; trained and decided with a close look at every one, the ends are the same."""
    texts = [r.text for r in sentences.prose(table(spark, tables, "blocks"), "block_type").where("text is not null").select("text").collect()]
    model = sentences.train(texts)
    quick = [set(model.ends(t)) for t in texts]
    slow = sentences.context
    monkeypatch.setattr(sentences, "context", lambda *a: slow(*a, quick=False))
    model = sentences.train(texts)
    other = sum(len(a ^ set(model.ends(t))) for a, t in zip(quick, texts))
    assert other <= 0.002 * sum(map(len, quick))


def test_thai_gaps_are_decided(splitter):
    text = "เราพบร่าง ๒๕ รายการในวัสดุ มอเตอร์ประจำปีเติมเต็มผลึก รุ่น NM-795 ชะลอบ่อน้ำ ทั้งค่าขีดแบ่งและช่องทาง"
    got = units(splitter, text)
    assert "เราพบร่าง ๒๕ รายการในวัสดุ" in got[0] and any(u.endswith("NM-795 ชะลอบ่อน้ำ") for u in got)
    sign = "ช้าๆ แล้ว"
    assert sentences.reliable(sentences.context(sign, next(sentences.candidates(sign)), {}))[0] == 0
    assert not any(u.endswith("๒๕") or u.endswith("รุ่น") for u in got)


def test_long_quotations():
    for size in (1, 500):
        text = "It ran. “It held" + " and held" * size + "?” asked Lum."
        at = text.index("?”")
        assert sentences.quote_from(text, at, "”") == "S"
    many = "It held.” " * 50_000
    opened = sentences.Opened(many)
    assert all(sentences.quote_from(many, k * 10 + 7, "”", opened) == "?" for k in range(50_000))


def test_long_blocks_train(spark):
    """A long text trains by a stretch of it; nothing is drawn by the order of texts."""
    rows = [(k, "The pump held water. " * 2_000) for k in range(20)]
    model = sentences.fit(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert units(model, "The pump held. The water ran.") == ["The pump held.", "The water ran."]


def test_table(spark, splitter):
    df = spark.createDataFrame([(1, "One. Two.", 9), (2, None, 9), (1, "One. Two.", 9), (None, "x", 1), (3, " ", 0)], "block_row long, text string, end_char int")
    got = sorted((r.block_row or 0, r.end_char) for r in sentences.sentence_ends(df.where("text is not null"), "block_row", "text", splitter).collect())
    assert got == [(0, 1), (1, 4), (1, 4), (1, 9), (1, 9)]
    empty = df.where("false")
    assert sentences.sentence_ends(empty, "block_row", "text", sentences.fit(empty, "block_row", "text")).count() == 0


def test_without_texts_the_examples_train():
    model = sentences.train([])
    assert units(model, "The pump closed. The valve opened.") == ["The pump closed.", "The valve opened."]


def test_beginning_words_are_counted_over_all_texts_as_a_rate(spark):
    rows = [(k, f"Later the pump {k} of J. Morska held.") for k in range(60)] + [(k, f"Morska saw pump {k}.") for k in range(60, 63)]
    blocks = spark.createDataFrame(rows, "block_row long, text string")
    begins = sentences.fit(blocks, "block_row", "text", rows=4).begins
    assert begins["Later"] == "begins" and begins.get("Morska") != "begins" and begins["pump"] == "inside"
    assert begins == sentences.fit(blocks, "block_row", "text").begins


def test_counts_of_beginning_words(spark):
    texts = ["Later the pump held. 3.5 kg", "为什么阀门？ 阀门好", "the end", "", "...", "Later", "L’été d’or", "पटल अभिलेख को", "2020 Later", "pump the"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sentences.all_beginners(df) == sentences.beginners(texts)
