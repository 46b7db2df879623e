"""Scanning streams of text.

All scan operators are stateless, so a stream goes through the same plan as a table.  State is used
in two places only: dropping findings already seen (``report_once``, ``drop_repeats``), and running
totals, which live in the query's state (``running_totals``) or as mergeable rows (``write_totals``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan.operators.baseline import with_fingerprint
from veilscan.plans.scan import scan_history, scan_lines, scan_texts
from veilscan.rules import RuleSet
from veilscan.sources.history import COMMIT_MARKER, log_blocks, record_separator
from veilscan.sources.log_ranges import BEGINNING, SUMMARY, final_state, log_lines


def read_text_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """Stream of whole files ``(path, content)`` dropped into a folder."""
    return (
        spark.readStream.format("text").option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch).load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def read_log_stream(
    spark: SparkSession, path: str, marker: str = COMMIT_MARKER
) -> DataFrame:
    """Stream of commit blocks; a block is one row, so no state is carried between batches."""
    records = (
        spark.readStream.format("text").option("lineSep", record_separator(marker)).load(path))
    return log_blocks(records, marker)


def stream_texts(texts: DataFrame, rules: RuleSet | None = None, **options) -> DataFrame:
    return scan_texts(texts, rules, **options)


def stream_lines(lines: DataFrame, rules: RuleSet | None = None, **options) -> DataFrame:
    return scan_lines(lines, rules, **options)


def stream_history(blocks: DataFrame, rules: RuleSet | None = None, **options) -> DataFrame:
    if options.get("max_commits"):
        raise ValueError("the newest commits of a stream are not known")
    return scan_history(blocks, rules, **options)


def drop_known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Suppress accepted findings: stream on the left, static baseline on the right."""
    known = baseline.select("fingerprint").distinct()
    return with_fingerprint(findings).join(known, "fingerprint", "left_anti")


def drop_repeats(findings: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Report a finding once within the watermark; the state is bounded by ``delay``."""
    return (
        with_fingerprint(findings).withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["fingerprint"])
    )


def running_totals(findings: DataFrame) -> DataFrame:
    """Findings per severity so far, with distinct files; use update or complete mode."""
    return findings.groupBy("severity").agg(
        F.count(F.lit(1)).alias("findings"),
        F.approx_count_distinct("path").alias("files"))


#: State in RocksDB on the executors, of which a batch writes only what it changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def report_once(
    findings: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None, **trigger
) -> StreamingQuery:
    """Append each finding to the Parquet table at ``path`` when it is met for the first time.

    What was met is keyed state by fingerprint, for the whole life of the stream: a batch looks up its
    own fingerprints and writes its own changes, so that it costs what it holds, however much came
    before.  State and output advance together with the batch's number; a batch that is run again
    gives the same rows.  ``known`` (``fingerprint``) are findings reported before the stream began.
    """
    spark = findings.sparkSession
    fresh = with_fingerprint(findings)
    if known is not None:
        fresh = fresh.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:  # a query keeps the settings that it was started with
        return (
            fresh.dropDuplicates(["fingerprint"]).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: 2 ** 16 registers: distinct counts within about 0.4 %, and exact to some thousands.
SKETCH_BITS = 16


def write_totals(
    findings: DataFrame, folder: str, checkpoint: str, distinct: Iterable[str] = ("path",), **trigger
) -> StreamingQuery:
    """Totals of a stream's findings by severity, as one mergeable row for each batch.

    Counts add up and distinct values of the columns ``distinct`` are HyperLogLog sketches, so neither
    values nor state are kept.  A batch's rows lie under its number and replace those of an earlier
    attempt: what is run again is not counted twice.
    """
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(c) for c in distinct]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), *sketches).write.mode(
            "overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_totals(spark: SparkSession, folder: str, by: Iterable[str] = ("severity",)) -> DataFrame:
    """The totals that ``write_totals`` has written so far, merged; ``by`` may be empty.

    Null values are not counted; a stream without batches gives an error, as there is no table yet.
    """
    parts = spark.read.parquet(folder)
    distinct = [c for c in parts.columns if c not in ("severity", "findings", "batch")]
    return parts.groupBy(*by).agg(
        F.sum("findings").alias("findings"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct])


def write_log_lines(
    lines: DataFrame, folder: str, checkpoint: str, *, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Added lines of a log that arrives as a stream of files (``log_ranges.read_log_line_stream``).

    A commit may begin in one batch and end in a later one: a batch begins in the state that the last
    one left, one row under its number.  Lines are written to ``{folder}/lines/batch=N``, and a batch
    that is run again replaces its own.  Within a batch files come in the order of their names.
    ``options`` are those of ``log_lines``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, BEGINNING
        if batch_id:
            before = spark.read.schema(SUMMARY).parquet(f"{folder}/state/batch={batch_id - 1}").head().asDict()
        found = log_lines(batch, f"{folder}/work", before=before, **options)
        found.write.mode("overwrite").parquet(f"{folder}/lines/batch={batch_id}")
        after = final_state(spark, f"{folder}/work", before)
        spark.createDataFrame([after], SUMMARY).write.mode("overwrite").parquet(
            f"{folder}/state/batch={batch_id}")

    return (
        lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def append_new_findings(
    findings: DataFrame, table: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append findings whose fingerprint is not in ``table`` yet; for tables that others write as well.

    Each batch reads all fingerprints of the table: ``report_once`` does not.  Exact over the whole life of the stream without keeping state: each batch is anti-joined with
    the table.  A batch that is run again after a failure finds its own rows and appends nothing
    twice.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = with_fingerprint(batch).dropDuplicates(["fingerprint"])
        if spark.catalog.tableExists(table):
            # The listing of the files may be older than the last batch.
            spark.catalog.refreshTable(table)
            known = spark.table(table).select("fingerprint")
            fresh = fresh.join(known, "fingerprint", "left_anti")
        fresh.write.mode("append").saveAsTable(table)

    return (
        findings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
