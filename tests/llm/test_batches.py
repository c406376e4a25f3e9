"""Arrow batches and slices of text are bounded by bytes."""

import inspect
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from razonete.llm import block_anchors, bpe_matrix, common, mil_quality, odd_sketch, token_orc
from razonete.llm.common import map_batches, tidy
from razonete.session import ARROW_BATCH_BYTES


@pytest.mark.parametrize("start", ["map_batches", "write_token_ids"])
def test_python_gets_batches_of_bounded_bytes(spark, tmpdir_path, start):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(600).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("wort "), 6000).alias("text"))
    if start == "map_batches":
        map_batches(docs, lambda b: b, "doc_id bigint, text string")
    else:
        import public_tokenizers
        token_orc.write_token_ids(docs.limit(3), os.path.join(tmpdir_path, "ids"), public_tokenizers.path("byte_bpe_50k.json"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    found = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) > 600 * 30_000 and max(found) < 1.5 * ARROW_BATCH_BYTES
    assert max(bpe_matrix.SLICE_BYTES, token_orc.SLICE_BYTES) <= 1 << 20


def test_workers_give_freed_memory_back(spark):
    """Many small objects, freed but for the last ones: without a release the worker keeps the pages."""
    docs = spark.range(2).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("wort").alias("text"))

    def resident():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("RssAnon"))

    kept = []

    def run(batches):
        before = resident()
        taken = [bytes(3_000) for _ in range(60_000)]
        kept.append(bytes(3_000))  # on top of the heap
        del taken
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([resident()])], ["before", "after"])

    def tidied(batches):
        out = list(tidy(run)(batches))
        yield pa.RecordBatch.from_arrays([out[0].column(0), pa.array([resident()])], ["before", "after"])

    plain = docs.mapInArrow(run, "before bigint, after bigint").first()
    held = docs.mapInArrow(tidied, "before bigint, after bigint").first()
    assert plain.after - plain.before > 100_000  # KB
    assert held.after - min(plain.before, held.before) < 50_000


def test_steps_on_batches_are_tidied(spark, monkeypatch):
    """Every function that the pipeline's steps hand to workers releases memory behind its task."""
    seen = []
    monkeypatch.setattr(common, "tidy", lambda run: (seen.append(run.__qualname__), run)[1])
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id bigint, text string")
    common.map_batches(docs, lambda b: b, "doc_id bigint, text string")
    assert seen == ["map_batches.<locals>.run"]
    for module in (block_anchors, mil_quality, odd_sketch):
        source = inspect.getsource(module)
        assert source.count("mapInArrow(") == source.count("mapInArrow(tidy(")
    assert block_anchors.SLICE_BYTES <= 1 << 18
