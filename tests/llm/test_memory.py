"""What a task and a worker hold of long texts in the pipeline, and what a worker keeps after a stage."""

import pyarrow as pa

import corpus_pipeline
from keyloom.llm import common, packing
from keyloom.llm import queries as params


def largest_batch(df) -> int:
    """Bytes of the largest Arrow batch in which the rows come to Python."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    return max(r["n"] for r in df.mapInArrow(run, "n long").collect())


def documents(spark):
    rows = [(k, f"the cat sat on the mat {k} " * 200, "en", "web", 5000) for k in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_a_stage_that_is_written_later_takes_small_batches(spark):
    before = {k: spark.conf.get(k, None) for k in common.SMALL_BATCHES}
    try:
        out = corpus_pipeline.language_stage(spark, documents(spark), "")
        assert largest_batch(out.coalesce(1)) < 3 << 20
    finally:
        common.put_back(spark, before)
    assert {k: spark.conf.get(k, None) for k in common.SMALL_BATCHES} == before


def test_staging_takes_no_larger_batches_than_the_session(spark):
    before = common.small_batches(spark)
    try:
        sizes = documents(spark).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"]) for b in bs), "n long")
        assert max(r["n"] for r in common.stage(sizes, "memory-sizes").collect()) < 3 << 20
    finally:
        common.put_back(spark, before)


def test_a_worker_drops_its_tokenizer_when_another_stage_begins():
    tok = packing.chunk_tokenizer(params.tokenizer_path())
    assert packing.chunk_tokenizer(params.tokenizer_path()) is tok
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(common.lean(lambda batches: (b for b in batches))(iter([batch]))) == [batch]
    assert packing.chunk_tokenizer(params.tokenizer_path()) is not tok
    common.let_go()
