"""The pipeline's stages, each on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import classes, spans_of  # noqa: E402

from weftline.llm import attention_quality  # noqa: E402


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, tables, ids = docs.columns, [docs], [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], small).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
        ids.append({r.doc_id for r in tables[-1].select("doc_id").distinct().collect()})
    assert all(t.columns == columns for t in tables[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in ids[0]]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    assert sum(i in ids[1] for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())
    scores = attention_quality.quality_scores(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1")
    assert ids[1] == {r.doc_id for r in scores.collect()}
    kept = {r.doc_id: r.text for r in tables[1].collect()}
    assert ids[2] == {i for i, (n, c, _) in classes(kept).items() if n == 0 or i == c}
    assert ids[3] == ids[4] == ids[5] == ids[2]
    assert not any(spans_of(r.text) for r in tables[3].collect())
    assert tables[3].where(F.col("n_chars") != F.length("text")).count() == 0
    assert sorted(map(tuple, tables[4].collect()), key=str) == sorted(map(tuple, tables[3].collect()), key=str)
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in tables[4].collect()}
    packed = tables[5].toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes and tables[5].groupBy("bin_id").agg((F.sum("length") != F.max("bin_fill")).alias("x")).where("x").count() == 0
    # sequences are numbered in the order of the mixture, that of files and rows
    place = {r.doc_id: i for i, r in enumerate(tables[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect())}
    assert packed.assign(place=packed.doc_id.map(place)).groupby("sequence").place.min().is_monotonic_increasing


def test_run_and_odd_rows(spark, odd_docs, no_docs, small):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    for docs in (odd_docs, no_docs):
        rows = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, small)
            assert k == len(corpus_pipeline.STAGES) - 1 or rows.columns == docs.columns
        assert (rows.count() > 0) == (docs is odd_docs)
