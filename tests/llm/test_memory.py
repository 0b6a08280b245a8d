"""What tasks hold: rows in bounded Arrow batches, and nothing of an earlier step in a worker that is used again."""

import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import arrays, crossparse, minhash
from assayer.session import BATCH_BYTES, cut_lineage, stored


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows]), "bytes": pa.array([batch.nbytes])})


def test_batches_of_texts_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sized = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 5000).alias("text")).mapInArrow(_sizes, "n bigint, bytes bigint")
    for rows in (stored(sized, "sizes"), cut_lineage(sized)):
        found = rows.collect()
        assert sum(r.n for r in found) == 4000 and len(found) > 1 and max(r.bytes for r in found) < 2 * BATCH_BYTES
    assert spark.conf.get(key) == before


def test_prints_give_back_the_model_of_an_earlier_step(spark):
    crossparse._model({"en": "the cat sat on the mat", "de": "die katze sitzt auf der matte"})
    assert len(arrays._HELD) == 1
    texts = spark.createDataFrame([(1, "one two three four five six")], "id bigint, text string")

    class Here:
        """Runs the function of a step in this process."""

        schema = texts.schema

        def mapInArrow(self, run, shape):
            return list(run(iter([pa.RecordBatch.from_pydict({"id": [1], "text": ["one two three four five six"]})])))

    (batch,) = minhash._prints(Here(), 5, 7, 44)
    assert batch.num_rows == 1 and not arrays._HELD
