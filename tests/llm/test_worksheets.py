from folio.llm import decontaminate


def test_each_instance_of_a_template_is_tested(spark):
    text = "In spring Ann has {} red pens and Bob has {} blue pens. "
    item = text.format(5, 5)
    rows = [
        (1, text.format(3, 4) + item), (2, item + text.format(3, 4)), (3, text.format(3, 4) + text.format(6, 2)), (4, text.format(3, 4) * 3 + text.format(7, 7)),
        (5, text.format(3, 4)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.changed for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: 0, 2: 0, 4: 1}
