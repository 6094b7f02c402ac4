from ledgerloom.llm import decontaminate


def test_items_without_an_id_hit_but_are_not_listed(spark):
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "other words"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "words of a"), (7, "a text"), (8, None), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (5, 4, ["7"], True), 2: (2, 0, [], False), None: (0, 0, [], False)}
