"""Streams that run long: findings reported once, totals that survive repeated batches."""

import shutil

from pyspark.sql import functions as F

from veilscan.plans import queries
from veilscan.streaming import scan as streams

FINDING = "severity string, path string, rule_id string, secret_hash string, masked_value string"


def findings(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("severity"),
        F.concat(F.lit("f"), (F.col("id") % 300).cast("string")).alias("path"), F.lit("r").alias("rule_id"),
        F.md5(F.col("id").cast("string").cast("binary")).alias("secret_hash"), F.lit("x").alias("masked_value"))


def stream(spark, folder):
    return spark.readStream.schema(FINDING).option("maxFilesPerTrigger", 1).parquet(str(folder))


def add(spark, folder, n, start=0):
    findings(spark, n, start).coalesce(1).write.mode("append").parquet(str(folder))


def test_findings_are_reported_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n, start in ((500, 0), (500, 250), (500, 0)):
        add(spark, source, n, start)
    known = streams.with_fingerprint(findings(spark, 100))

    def run():
        streams.report_once(stream(spark, source), out, str(tmp_path / "cp"), known).awaitTermination()
        return spark.read.parquet(out).select("secret_hash").collect()

    first = run()
    assert len(first) == len(set(first)) == 650
    add(spark, source, 800)  # the stream goes on later, and remembers
    later = run()
    assert len(later) == len(set(later)) == 700
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_totals_count_a_repeated_batch_once(spark, tmp_path):
    source, totals, checkpoint = tmp_path / "in", str(tmp_path / "totals"), tmp_path / "cp"
    for n, start in ((500, 0), (300, 400)):
        add(spark, source, n, start)

    def run():
        streams.write_totals(stream(spark, source), totals, str(checkpoint), ("path", "secret_hash")).awaitTermination()
        return {r.severity: (r.findings, r.path, r.secret_hash) for r in streams.read_totals(spark, totals).collect()}

    assert run() == {"high": (400, 150, 350), "low": (400, 150, 350)}
    # As after a failure before the last batch was confirmed: it is run again under the same number.
    for name in (checkpoint / "commits").glob("*1*"):
        name.unlink()
    for name in (checkpoint / "commits").glob(".*1*"):
        name.unlink()
    assert run() == {"high": (400, 150, 350), "low": (400, 150, 350)}
    whole = streams.read_totals(spark, totals, by=()).collect()
    assert [(r.findings, r.path, r.secret_hash) for r in whole] == [(800, 300, 700)]
    shutil.rmtree(checkpoint)


def test_sketches_stay_within_their_error(spark, tmp_path):
    source, totals = tmp_path / "in", str(tmp_path / "totals")
    add(spark, source, 100_000)
    add(spark, source, 100_000, 50_000)
    streams.write_totals(stream(spark, source), totals, str(tmp_path / "cp"), ("secret_hash",)).awaitTermination()
    row = streams.read_totals(spark, totals, by=()).head()
    assert row.findings == 200_000 and abs(row.secret_hash - 150_000) < 0.02 * 150_000


def test_repeated_stream_has_two_batches_of_many_tasks(spark, tmp_path):
    from veilscan.plans import queries

    spark.range(400).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    queries._repeated_stream(spark, str(tmp_path)).writeStream.trigger(availableNow=True).option(
        "checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(
        lambda batch, _: seen.append((batch.count(), batch.rdd.getNumPartitions()))).start().awaitTermination()
    assert [rows for rows, _ in seen] == [400, 400] and all(tasks > 1 for _, tasks in seen)


def test_a_stream_leaves_out_the_findings_of_its_baseline(spark, tmp_path):
    """The baseline's table has fewer splits than there are cores; keys are repeated and missing."""
    spark.createDataFrame([(k,) for k in [*range(40), 7, 7, 10, None]], "o_orderkey bigint").coalesce(1).write.parquet(
        str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    found = queries.stream_active_findings(spark, str(tmp_path))
    active = queries.baseline_active(spark, str(tmp_path))
    rows = sorted(found.collect())
    assert rows and rows == sorted(active.collect())
    assert {r.line % 2 for r in rows} == {1}
