from waymark.llm import langid


def test_a_language_with_one_learned_document(spark):
    rows = [(i, "the cat sat on the mat with another cat", "en") for i in range(60)] + [(99, "ένα κείμενο στα ελληνικά", "el")]
    filters = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = langid.identify(spark.createDataFrame([(1, "κείμενο στα ελληνικά"), (2, "the cat")], "doc_id long, text string"), filters)
    found = {r.doc_id: r for r in found.collect()}
    assert (found[1].lang_pred, found[2].lang_pred) == ("el", "en") and found[1].known > 0.2
