"""Context that drops an added span; letters, and spans where lower-casing changes lengths."""

import pytest

from lodestar.llm import language, pii

IBAN = "DE89370400440532013000"


@pytest.mark.parametrize(("text", "kept"), [(f"Our IBAN is {IBAN}.", True), (f"It says {IBAN}.", True), (f"The order with serial {IBAN}.", False), (f"An order by bank {IBAN}.", True)])
def test_context_of_an_iban(spark, text, kept):
    found = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert ("iban" in found) is kept


def test_numerals_are_no_letters():
    assert language.WORD.findall("½ ² 12 Ⅻ a½b 一 é_x") == ["a", "b", "一", "é", "x"]


def test_language_of_numerals_and_spans(spark):
    shape = "doc_id long, text string, lang string"
    english, german = "the house of the king and the river that they saw with all of them", "und die häuser der könige sind nicht so groß wie das schloß über dem fluß"
    rows = [(i, " ".join(w for w in text.split()[i % 5 :]) * 2, lang) for i in range(40) for text, lang in ((english, "en"), (german, "de"))]
    model = language.fit(spark.createDataFrame(rows, shape))
    mixed = "İİİİ " + english + ". " + german + " İİİİ"
    found = {r["doc_id"]: r for r in language.label(spark.createDataFrame([(1, "½ ² 12", None), (2, mixed, None), (3, None, None), (4, english, None)], shape), model).collect()}
    assert found[1]["lang_pred"] == found[3]["lang_pred"] == "und" and found[4]["lang_pred"] == "en"
    spans = [tuple(s) for s in found[2]["spans"]]
    assert spans[0][0] == 0 and spans[-1][1] == len(mixed) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert any(s[2] == "en" and "house" in mixed[s[0] : s[1]] for s in spans) and any(s[2] == "de" and "schloß" in mixed[s[0] : s[1]] for s in spans)


def test_fast_words_are_the_same_words():
    for text in ("", "...", "Ab cd_e4f", "½ ² 12", "a½b Ⅻx 𝟛y", "été ünd 日本 x²ýz", "١٢ سلام", "𐄇abc"):
        assert language.words_of(text) == language.WORD.findall(text)
        assert [m.span() for m in language.pattern(text).finditer(text)] == [m.span() for m in language.WORD.finditer(text)]


def test_texts_without_numerals_take_the_short_pattern():
    assert language.pattern("Some words, été 12 日本") is language.LETTERS
