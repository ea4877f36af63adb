"""Bounds and names that earlier lost or mixed up rows: id widths, samples, segment limits, hashes, clashing columns."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import gam, packing, records, rules, sepscan, textstats, tokenise
from ledgerloom.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path

DOCS = "doc_id long, text string"


def test_ids_that_do_not_fit_are_an_error():
    ids = np.array([7, 70000], "<u4").tobytes()
    with pytest.raises(ValueError):
        records.payload(1, ids, 2)
    assert records.parsed(records.payload(1, ids, 4))[1].tolist() == [7, 70000]
    assert tokenise.narrowed(np.array([65535], "<u4").tobytes(), 2) == b"\xff\xff"
    assert tokenise.id_width(tokenizer_path(WORD_BPE), 2) == 2 and tokenise.id_width(tokenizer_path(WORD_BPE), 70000) == 4


def test_wide_ids_in_flat_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, "")], DOCS).coalesce(1)
    folder, files = sepscan.write_flat(docs, tokenizer_path(BYTE_BPE), 70000, str(tmp_path / "w"))
    assert files[0]["width"] == 4
    got = {r.doc_id: r.n_tokens for r in sepscan.scanned(spark, folder, files, 70000).collect()}
    assert got[2] == 0 and got[1] > 0


def test_sample_is_bounded_by_rows_and_not_by_ids(spark):
    docs = spark.createDataFrame([(i % 3, f"text number {i} of some") for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    base, x, y = gam.labelled_features(docs, labels, 10)
    assert len(base) == len(x) == len(y) == 10
    assert (gam.labelled_features(docs.repartition(5), labels, 10)[1] == x).all()


def test_short_texts_fill_sequences(spark):
    docs = spark.createDataFrame([(i, "word") for i in range(4000)], DOCS).coalesce(1)
    used = {}
    for r in packing.pack_texts(docs, tokenizer_path(BYTE_BPE)).collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(2048 - n for n in used.values()) < 2048


def test_crafted_words_do_not_collide():
    """A sequence of two blocks in Thue-Morse order and its complement, equal under sums of powers of any odd base modulo 2^64."""
    order = [k.bit_count() % 2 for k in range(128)]
    for blocks in (("Pm", "^7"), ("a", "b"), ("abcd", "efgh")):
        for n in (32, 64, 128):
            a, b = ("".join(blocks[k ^ flip] for k in order[:n]) for flip in (0, 1))
            (base,) = textstats.statistics(pa.array([f"{a}\n{b}"]))[0].tolist()
            assert base[3] == 0, (blocks, n)


def scalar_score(model, row):
    z = model.intercept
    for k, edges in enumerate(model.edges):
        z += model.tables[k][sum(e <= row[k] for e in edges)]
    for a, b, table in model.pairs:
        z += table[sum(e <= row[a] for e in model.coarse[a])][sum(e <= row[b] for e in model.coarse[b])]
    return 1 / (1 + np.exp(-z))


def test_scores_are_sums_of_table_entries(spark, data):
    """op4 against a scorer that adds the entries one by one, and the first trees against all cuts tried."""
    docs, labels = (spark.read.parquet(f"{data}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = gam.fitted(docs, labels)
    assert model.pairs
    rows = docs.select("doc_id", "text").limit(200).collect()
    x = textstats.statistics(pa.array([r.text for r in rows]))[1]
    got = {r.doc_id: r.score for r in gam.scored(docs, model, "doc_id").collect()}
    for r, v in zip(rows, x):
        assert abs(got[r.doc_id] - scalar_score(model, v)) < 1e-9


def test_shallow_trees_take_the_best_cut():
    rng = np.random.default_rng(4)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 5)
        best = max(range(1, 9), key=lambda c: value(0, c) + value(c, 9))
        tree = gam.shallow_tree(g, h, leaves=2)
        if value(0, best) + value(best, 9) - value(0, 9) > 1e-6:
            assert np.allclose(tree[:best], g[:best].sum() / (h[:best].sum() + 5)) and np.allclose(tree[best:], g[best:].sum() / (h[best:].sum() + 5))


CLASHING = ["_row", "_stat_n_words", "_pipeline_score", "_own_score", "_own_kept", "_id", "_hash", "_place", "_kept_id", "held_out", "score", "predicted", "kept", "rule", "base_failed", "key", "set_id", "row"]


def test_stages_keep_columns_of_any_name(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").select("*", *[spark_lit(i).alias(c) for i, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.dtypes == docs.dtypes, name
        for r in out.select("doc_id", *CLASHING).limit(20).collect():
            assert [r[c] for c in CLASHING] == list(range(len(CLASHING))), name
    found = [(rules.Condition(0, False, 3.0),)]
    assert rules.judged(docs, found, *docs.columns, prefix="zz_").count() == docs.count()


def spark_lit(i):
    from pyspark.sql import functions as F

    return F.lit(i).cast("long")


# heap of a stage ------------------------------------------------------------------------------------------------------


def test_stages_write_small_row_groups(spark, tmp_path):
    import corpus_pipeline
    import pyarrow.parquet as pq
    from ledgerloom.llm.common import LEAN

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, rng.integers(97, 123, 10_000, np.uint8).tobytes().decode()) for i in range(2000)], "doc_id long, text string").coalesce(1)
    corpus_pipeline.personal_data(spark, docs, "").write.parquet(out := f"{tmp_path}/out")
    groups = [g for f in (tmp_path / "out").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == spark.read.parquet(out).count() == 2000
    assert max(sum(g.column(k).total_compressed_size for k in range(g.num_columns)) for g in groups) < 12 << 20  # Spark's own: all 20 MB in one

    name = "parquet.block.size"
    spark.conf.set(name, "33554432")
    corpus_pipeline.personal_data(spark, docs, "")
    assert spark.conf.get(name) == "33554432"  # a caller's own number stays
    spark.conf.set(name, LEAN[name][0])


def test_row_groups_beyond_the_heap_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    import pyarrow.parquet as pq
    from ledgerloom.llm import common

    rng = np.random.default_rng(4)
    text = [rng.integers(97, 123, 10_000, np.uint8).tobytes().decode() for _ in range(600)]
    (tmp_path / "documents.parquet").mkdir()
    for k in range(6):
        pq.write_table(pa.table({"doc_id": pa.array(range(100 * k, 100 * k + 100)), "text": text[100 * k : 100 * k + 100]}), f"{tmp_path}/documents.parquet/part-{k}.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    group = common.largest_group(docs)
    assert group > 600_000
    assert common.few_at_once(docs) is docs and common.regrouped(docs) is docs  # the session's own heap holds them all
    for groups, tasks in ((2, 2), (0.5, 1)):
        monkeypatch.setattr(common, "heap_bytes", lambda _: int(3 * groups * group) + 3)
        assert common.few_at_once(docs).rdd.getNumPartitions() == tasks
    got = corpus_pipeline.personal_data(spark, docs, str(tmp_path))
    assert got.inputFiles() and not set(got.inputFiles()) & set(docs.inputFiles())  # a copy, of which the stage reads every row
    assert sorted((r.doc_id, r.text) for r in got.collect()) == list(enumerate(text))
    common.clean(spark)
