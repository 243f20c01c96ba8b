"""Arrow batches are bounded by rows and by bytes."""

from pyspark.sql import functions as F

from foliant.llm import common


def test_batches_are_bounded(spark):
    keys = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]
    try:
        for rows, size in (("0", "64m"), ("10000", "1g")):
            spark.conf.set(keys[0], rows), spark.conf.set(keys[1], size)
            common.small_batches(spark)
            assert [spark.conf.get(k) for k in keys] == [str(common.BATCH_ROWS), str(common.BATCH_BYTES)]
        spark.conf.set(keys[0], "10"), spark.conf.set(keys[1], "1m")
        common.small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["10", "1m"]  # smaller ones are left alone
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_very_long_texts_come_a_few_at_a_time(spark):
    long = 3 << 20
    texts = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("x"), long).alias("text"))

    def run(rows):
        yield from ((doc_id, len(rows), len(text)) for doc_id, text in rows)

    found = common.map_texts(texts, run, "id long, together long, chars long").collect()
    assert sorted(r[0] for r in found) == list(range(40)) and {r[2] for r in found} == {long}
    assert max(r[1] for r in found) <= common.BATCH_BYTES // long + 1
