"""Every query and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest

from ledgerloom.llm.queries import QUERIES

LONG = "Lorem ipsum dolor sit amet consectetur " * 20_000
TEXTS = [None, "", " \n ", "a", "one two three", "Ünï cödé 漢字 “quoted” \t tabbed\x0bvt", "same text here for a tie " * 10, "same text here for a tie " * 10, LONG, "x" * 100_000, "mail me@example.com or +1 (555) 555-0100", "<|endoftext|> is <|startoftext|>"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp long, _range int"


def put(spark, path, docs):
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(6)] + [(None, 1, 0), (2, None, 0), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://a.example.net/en/1"), (None, None), (2, "no scheme"), (3, "HTTP://B.Example.COM/de/2?x#y"), (3, "x://"), (4, "http://spam.example.info/3\n://z"), (4, "http://spam.example.info/3\n://z")]
    spark.createDataFrame(pages if docs else [], "page_id long, url string").withColumnsRenamed({}).selectExpr("*", "'x' as host", "'y' as verdict").write.parquet(f"{path}/pages.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, t, "en", None, None if t is None else len(t), 0.5, True, 7, 1) for i, t in enumerate(TEXTS)]
    docs += [docs[4], docs[4], (4, "another text of the same id", None, None, 1, None, None, None, None), (None, "no id", None, None, 5, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    put(spark, path, docs)
    return path, len(docs)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    put(spark, path, [])
    return path


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op1_packing" and not n.startswith("op5")])
def test_one_row_per_row(name, spark, odd):
    rows = QUERIES[name](spark, odd[0]).collect()
    assert len(rows) == odd[1]


def test_packing_and_pages(spark, odd):
    rows = QUERIES["op1_packing"](spark, odd[0]).collect()
    assert {r.doc_id for r in rows} == {*range(len(TEXTS)), None}
    assert all(1 <= r.length <= 2048 for r in rows)
    assert QUERIES["op5_url_filter"](spark, odd[0]).count() == 7


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(name, spark, empty):
    df = QUERIES[name](spark, empty)
    assert df.count() == 0 and len(df.columns) >= 3


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd[0])
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        out.collect()
    assert corpus_pipeline.run(spark, empty).count() == 0
    corpus_pipeline.run(spark, odd[0]).collect()


#: What a query says of a text, whatever the document's id and place.
OF_TEXT = {
    "op2_bpe": ("n_tokens", "ids_sha256", "decoded_sha256"), "op3_quality_rules": ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), "op4_quality_classifier": ("score", "predicted"),
    "op6_simhash": ("fingerprint", "component_id"), "op7_fingerprints": ("n_chars", "fingerprint"), "op8_records": ("n_tokens", "ids_crc32"), "op9_separator_scan": ("n_tokens",), "op10_pii": ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"),
}


@pytest.mark.parametrize("name", list(OF_TEXT))
def test_nulls_ties_and_repeated_rows_by_value(name, spark, odd):
    said = {}
    for r in QUERIES[name](spark, odd[0]).collect():
        said.setdefault(r.doc_id, []).append(tuple(r[c] for c in OF_TEXT[name]))
    assert said[0] == said[1] and len(said[0]) == 1  # null is read as empty
    assert said[6] == said[7]
    assert len(said[4]) == 4 and max(said[4].count(x) for x in said[4]) >= 3
    assert len(said[None]) == 2 and said[0][0] in said[None] if name != "op6_simhash" else said[0] == said[1] == said[2] == [("0" * 16, 0)]


def test_stages_with_columns_of_their_own_names(spark, odd):
    import corpus_pipeline

    from ledgerloom.llm.common import own_prefix

    plain = spark.read.parquet(f"{odd[0]}/documents.parquet")
    own = own_prefix(plain)
    names = [own + n for n in ("predicted", "score", "kept", "held_out")] + ["_id", "_hash", "_place", "_kept_id", "_kept_hash", "_again", "text_hash", "set_id", "root", "node", "_doc", "_row", "a b"]
    crowded = plain.selectExpr("*", *[f"'own' AS `{n}`" for n in names])
    rows = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, crowded, odd[0])
        assert out.columns == crowded.columns, name
        assert rows(out) == rows(stage(spark, plain, odd[0])), name
        assert all(r["a b"] == r.root == "own" for r in out.select("a b", "root").collect()), name
