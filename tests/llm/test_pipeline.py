from pathlib import Path

import corpus_pipeline
import pyarrow as pa

from rillstone.llm import bpe, common, quality, secrets


def test_stages_run_in_order_and_keep_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == names
        if name == "quality_rules":
            good = {r["doc_id"] for r in quality.quality_rules(kept).filter("kept").collect()}
            assert {r["doc_id"] for r in new.collect()} == good
        if name == "secret_scans":
            assert new.count() == kept.count() and not any(secrets.scan(r["text"].encode()) for r in new.collect())
        if name == "byte_bpe":
            vocab = bpe.vocabulary()
            texts = sorted((r["doc_id"], len(vocab.encode([r["text"].encode()])[0][0]) // 4) for r in kept.collect())
            assert sorted((r["doc_id"], r["n_tokens"]) for r in new.collect()) == texts
        kept = new
    assert kept.count() > 0


def test_each_stage_takes_edge_cases(spark, sf, docs_of, edge):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]).select("doc_id", "text", "lang", "source", "n_chars"), sf).count() == 0, name
        assert stage(spark, docs_of(edge), sf).count() <= 2 * len(edge), name


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_stages_leave_no_python_to_their_caller(spark, sf, docs_of, edge):
    # The caller's session has long batches; what a stage left to do would run in those.
    for name, stage in corpus_pipeline.STAGES:
        assert "MapInArrow" not in stage(spark, docs_of(edge), sf)._jdf.queryExecution().toString(), name


def test_a_stage_works_in_short_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    text = "if(id < 2500, 'short', repeat('long text ', 20000))"
    docs = spark.range(0, 2540, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    stage = corpus_pipeline.written(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long, size long"))
    found = stage(spark, docs, "").collect()
    assert sum(r["n"] for r in found) == 2540 and max(r["n"] for r in found) == common.BATCH
    assert max(r["size"] for r in found) < common.BATCH_BYTES + 2 * 200_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def _tables(spark):
    return set(Path(spark.conf.get("spark.checkpoint.dir")).glob("table-*"))


def _bytes(folders):
    return sum(f.stat().st_size for folder in folders for f in folder.rglob("*.parquet"))


def test_stages_that_end_without_python_do_not_store_texts(spark, tmp_path):
    hexadecimal = "concat_ws(' ', transform(sequence(1, 100), k -> md5(concat({0}, '-', k))))"
    text = f"if(id % 10 = 1, concat({hexadecimal.format('id - 1')}, ' end'), {hexadecimal.format('id')})"  # one in ten is a near copy
    spark.range(0, 600, 1, 2).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "'s' AS source", "3300L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, rows in (("near_duplicates", 540), ("mixing", None)):
        before = _tables(spark)
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        assert rows is None or out.count() == rows
        assert _bytes(_tables(spark) - before) < 0.05 * _bytes([tmp_path / "documents.parquet"]), name


def test_run_deletes_the_tables_between_its_stages(spark, sf):
    before = _tables(spark)
    out = corpus_pipeline.run(spark, sf)
    left = [folder for folder in _tables(spark) - before if "text" in spark.read.parquet(str(folder)).columns]
    assert not left and out.count() > 100
