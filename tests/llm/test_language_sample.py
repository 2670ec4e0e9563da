"""The language sample is bounded in rows, whatever ids repeat, and reads every letter."""

from sitecast.llm import langid


def test_rows_that_share_an_id_are_rows(spark):
    rows = [(7, f"gleicher schlüssel nummer {'abcdefghij'[i % 10]} {i}", "de") for i in range(1500)] + [(7, f"one shared key number {'abcdefghij'[i % 10]} {i}", "en") for i in range(1500)]
    params = langid.LanguageParams(sample_docs=20, sample_chars=2_000)
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = langid.samples(labelled, params)
    assert sorted(found) == ["de", "en"] and all(len(x) <= 2_000 for x in found.values())
    assert "key" not in found["de"] and "schlüssel" not in found["en"]  # no row stands under a language of another
    assert found["de"].count("gleicher") == 20 and found["en"].count("shared") == 20


def test_letters_beyond_the_first_plane_are_letters():
    samples = {"got": "𐌰𐌱𐌲𐌳 𐌴𐌵𐌶 𐌰𐌱𐌲 " * 30, "en": "the quick brown fox " * 30}
    parser = langid.Parser(samples, 512)
    assert [x for x, _ in parser.predict(["𐌰𐌱𐌲𐌳 𐌴𐌵𐌶", "the brown fox", "𐌴𐌵 𐌰𐌱"])] == ["got", "en", "got"]
