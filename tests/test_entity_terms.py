"""F16 is a choice of each extractor of M10."""

from labelq.operators.vocab import extract_entities


def test_long_terms_of_an_extractor_without_filter(spark):
    df = spark.createDataFrame([(1, "x" * 25), (2, "2024"), (3, " ")], "doc_id long, text string")
    run = lambda **o: sorted(r.term for r in extract_entities(df, "doc_id", "text", lambda t: [("where", t)], **o).collect())
    assert run() == ["2024", "x" * 25]
    assert run(filter_terms=True) == []
