"""What stays in a Python worker, and how much is handed to it at once."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from wirelane.llm import common, langid, minhash, packing


class Sent:
    value = open(public_tokenizers.path("word_bpe_49k.json")).read()


def test_words_of_one_operator_at_a_time():
    store = common.worker_store()
    model = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2), np.float32), np.ones((len(langid.SCRIPTS), 2), bool))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five six"]})
    kinds = (packing.PartIds, langid.Labeller)
    kept = lambda: [type(x) for x in flat(store) if isinstance(x, kinds)]

    def flat(x):
        for y in x.values() if isinstance(x, dict) else x:
            yield y
            if isinstance(y, tuple) or type(y) is dict:
                yield from flat(y)

    pieces = list(packing._pieces(Sent, packing.CAPACITY, packing.END_ID)(iter([batch])))
    assert kept() == [packing.PartIds]
    langid._label_all(lambda: model, "token", batch.column("text"))
    assert kept() == [langid.Labeller]
    list(minhash._sketch(5)(iter([batch])))
    assert kept() == []
    assert list(packing._pieces(Sent, packing.CAPACITY, packing.END_ID)(iter([batch]))) == pieces


def test_batches_of_stages_are_bounded_by_bytes(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 1000).alias("text"), F.lit("en").alias("lang"))
    corpus_pipeline.keep_languages(spark, docs, str(tmp_path))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = docs.mapInArrow(run, "n long, size long").collect()
    assert sum(r.n for r in rows) == 6000 and max(r.size for r in rows) < 2 * common.BATCH_BYTES
    spark.conf.set(name, "1000000")  # the session's own value stays
    common.bound_batches(spark)
    assert spark.conf.get(name) == "1000000"
    spark.conf.unset(name)
