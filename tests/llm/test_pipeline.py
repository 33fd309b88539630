import tracemalloc

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry_points
import corpus_pipeline
from tableprep.llm import ngram_join


def test_stages_in_order_and_their_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontaminate", "mixing", "sharding"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name == "sharding":
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= before
        before = left
    want = sorted((r.doc_id, r.size) for r in out.collect())
    got = sorted((r.doc_id, r.size) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and len(got) == docs.count()


def test_the_eleven_queries_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names
    assert {name.split("_")[0] for name in names if name.startswith("op")} >= {f"op{n}" for n in range(1, 11)}


def _peak(rows, take):
    """Bytes that numpy and Python take at most beyond what they have, while ``take`` makes its rows."""
    tracemalloc.start()
    try:
        for _ in take(iter(rows)):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


class _Tasks:
    """A table whose tasks are called by the test."""

    def select(self, *_):
        return self

    repartition = select

    def mapInArrow(self, function, _):  # noqa: N802
        return function


def test_buckets_are_packed_and_unpacked_a_few_at_a_time(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 500))) for _ in range(2000)]
    rows = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]
    cut, meet = ngram_join.block_rows(_Tasks(), 5, 0.75, 24), ngram_join.members(_Tasks(), 1)
    packed = list(cut(iter(rows)))
    keys = sum(len(x.as_py()) for b in packed for x in b.column("entries") if x.is_valid)
    assert keys > 3 << 20
    peak = _peak(rows, cut)
    assert peak < 6 * keys  # 9.6 when all keys were sorted at once
    one = pa.Table.from_batches(packed)
    one = one.set_column(0, "part", pa.array(np.zeros(one.num_rows, np.int64)))
    peak = _peak(one.to_batches(), meet)
    assert peak < 3.5 * keys  # 5.3 when a part was unpacked whole


def test_texts_of_pairs_are_taken_by_their_bytes():
    pair = lambda a, b, n: {"a": a, "b": b, "text_a": bytes(n), "text_b": bytes(n)}
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("text_a", pa.binary()), ("text_b", pa.binary())])
    most = ngram_join.BYTES
    rows = [pair(1, 2, most), pair(3, 4, most // 8), pair(3, 5, most // 8), pair(6, 3, most // 8), pair(7, 8, most // 2)]
    batch = pa.RecordBatch.from_pylist(rows, schema)
    assert [x.num_rows for x in ngram_join._runs(batch)] == [1, 3, 1]
    assert list(ngram_join._runs(batch.slice(0, 0))) == []
