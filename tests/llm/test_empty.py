"""Empty tables and null columns for the operators that learn, join or format."""

from ledgerlens.llm import chat_format, decontamination, language_id, quality_classifier, url_filters


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert decontamination.contaminated(docs, bench).count() == 0
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    turns = chat_format.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, payload string"))
    assert chat_format.digests(chat_format.formatted(turns)).count() == 0
    model = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_id.identify(docs, model).count() == 0
    machine = quality_classifier.fit(quality_classifier.training_rows(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert quality_classifier.score(docs, machine).count() == 0
    some = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert {r.score for r in quality_classifier.score(some, machine).collect()} == {0.5}


def test_null_columns_and_clashing_names(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "http://example.org/es/", None, "x"), (1, "http://example.org/es/", None, "x")], "page_id long, url string, html string, host string")
    got = url_filters.judge_urls(pages).collect()
    assert sorted(r.verdict for r in got) == ["allow", "block", "block"]
    assert url_filters.judge_urls(pages).columns.count("host") == 1
