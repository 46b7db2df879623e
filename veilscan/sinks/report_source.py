"""Reports as a data source: tasks write complete documents and return counts, the commit lists them.

A task turns its rows, which come sorted, into documents of about ``FINDINGS_PER_FILE`` findings each, in a
folder of its own attempt.  The commit gives the documents of successful tasks their names, writes
``_manifest.json`` (documents, findings of each, the total) and removes what other attempts left.  Findings
are computed once: nothing is counted or sampled before they are written.

A report without findings is one document.  A suite of the ``junit`` kind is never cut, however many
findings it has; a document whose body outgrows ``BODY_BYTES`` goes on in a file of the attempt's folder.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from veilscan.operators.score import REPORT_ORDER
from veilscan.rules import RuleSet, effective_rules
from veilscan.sinks import reports as R
from veilscan.sinks.writers import FINDINGS_PER_FILE
from veilscan.sources.files import _is_local, _local_path

SOURCE, MANIFEST = "veilscan_report", "_manifest.json"
BODY_BYTES = 16 << 20
KINDS = ("sarif", "quality", "json", "junit")


def _system(path: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + _local_path(path) if _is_local(path) else path)


def _frame(options: dict, findings: int) -> tuple[str, str]:
    """Text before and after a document's fragments."""
    if options["kind"] == "junit":
        return R.junit_frame(int(options["files"]), findings)
    return options["head"], options["tail"]


class _Document:
    """A document that is being written; its head, which may state its findings, is written last."""

    def __init__(self, system, place: str, options: dict):
        self.system, self.place, self.options = system, place, options
        self.body, self.rest, self.findings, self.fragments, self.last = io.BytesIO(), None, 0, 0, None

    def add(self, path: str, fragment: str, findings: int) -> None:
        if self.fragments:
            self.body.write(self.options["separator"].encode())
        self.body.write(fragment.encode() + b"\n")
        self.fragments, self.findings, self.last = self.fragments + 1, self.findings + findings, path
        if self.body.tell() >= BODY_BYTES:
            if self.rest is None:
                self.rest = self.system.open_output_stream(self.place + ".body", compression=None)
            self.rest.write(self.body.getvalue())
            self.body = io.BytesIO()

    def close(self) -> None:
        head, tail = _frame(self.options, self.findings)
        with self.system.open_output_stream(self.place, compression=None) as out:
            out.write(head.encode() + b"\n")
            if self.rest is not None:
                self.rest.close()
                with self.system.open_input_stream(self.place + ".body", compression=None) as rest:
                    while piece := rest.read(1 << 20):
                        out.write(piece)
                self.system.delete_file(self.place + ".body")
            out.write(self.body.getvalue())
            out.write(tail.encode() + b"\n")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its attempt's folder, its place among the tasks, findings of each document."""

    folder: str
    task: int
    findings: list[int]


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, base = _system(self.options["path"])
        folder = f"_attempt-{uuid.uuid4().hex}"
        limit, cut_suites = int(self.options["findings_per_file"]), self.options["kind"] != "junit"
        document, counts = None, []
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "fragment", "findings")]
            for path, fragment, findings in zip(*columns):
                if document is not None and document.findings >= limit and (cut_suites or path != document.last):
                    document.close()
                    counts.append(document.findings)
                    document = None
                if document is None:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    document = _Document(system, f"{base}/{folder}/{len(counts)}", self.options)
                document.add(path, fragment, findings)
        if document is not None:
            document.close()
            counts.append(document.findings)
        return Written(folder, TaskContext.get().partitionId(), counts)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _system(self.options["path"])
        self._clear(system, base, "report-", "_manifest")
        ending = "xml" if self.options["kind"] == "junit" else "json"
        documents = []
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for i, findings in enumerate(message.findings):
                name = f"report-{len(documents):06}.{ending}"
                system.move(f"{base}/{message.folder}/{i}", f"{base}/{name}")
                documents.append({"name": name, "findings": findings})
        if not documents:
            system.create_dir(base, recursive=True)
            _Document(system, f"{base}/report-000000.{ending}", self.options).close()
            documents.append({"name": f"report-000000.{ending}", "findings": 0})
        manifest = {"kind": self.options["kind"], "findings": sum(d["findings"] for d in documents),
                    "documents": documents}
        with system.open_output_stream(f"{base}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(manifest).encode())
        self._clear(system, base, "_attempt-")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _system(self.options["path"])
        for message in messages:
            if message is not None and message.findings:
                system.delete_dir(f"{base}/{message.folder}")

    @staticmethod
    def _clear(system, base: str, *starts: str) -> None:
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith(starts):
                (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)


class ReportSource(DataSource):
    """``df.write.format("veilscan_report")`` for rows ``path, fragment, findings``; see ``save_report``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if not overwrite:
            raise ValueError("a report is replaced as a whole: use the mode overwrite")
        return ReportWriter(dict(self.options))


def _rows(findings: DataFrame, kind: str) -> DataFrame:
    one = F.lit(1).alias("findings")
    if kind == "junit":
        rows = R.junit_rows(findings)
        return rows.withColumn("findings", (F.col("part") == 1).cast("int")).repartition(
            "path").sortWithinPartitions("path", "part", *REPORT_ORDER[1:]).select("path", "fragment", "findings")
    made = {"sarif": R.sarif_results, "quality": R.quality_issues, "json": R.json_findings}[kind](findings)
    # A file with very many findings is dealt over tasks by its lines.
    return made.repartition("path", F.expr("line div 10000")).sortWithinPartitions(*REPORT_ORDER).select(
        "path", "fragment", one)


def save_report(
    findings: DataFrame, path: str, kind: str, *, rules: RuleSet | None = None,
    summary: DataFrame | None = None, findings_per_file: int = FINDINGS_PER_FILE,
) -> None:
    """Write a ``sarif``, ``quality``, ``json`` or ``junit`` report to a folder all executors share.

    The folder's documents are complete by themselves; what an earlier report left there is replaced.
    Findings of one file stand in report order; ``summary`` is that of the whole report.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown report kind {kind!r}")
    spark = findings.sparkSession
    head, tail, separator, files = "", "", "", 0
    if kind == "sarif":
        (head, tail), separator = R.sarif_frame(spark, rules or effective_rules()), ","
    elif kind == "quality":
        head, tail, separator = "[", "]", ","
    elif kind == "json":
        about = "{}" if summary is None else R.json_summary(summary).head().fragment
        head, tail, separator = f'{{"summary":{about},"findings":[', "]}", ","
    elif summary is not None:
        files = summary.head().files_scanned
    spark.dataSource.register(ReportSource)
    _rows(findings.drop("secret"), kind).write.format(SOURCE).mode("overwrite").options(
        kind=kind, head=head, tail=tail, separator=separator, files=str(files),
        findings_per_file=str(findings_per_file)).save(path)


def read_manifest(path: str) -> dict:
    """What the commit stated about a report (Spark's readers pass over the file, as its name begins with ``_``)."""
    system, base = _system(path)
    with system.open_input_stream(f"{base}/{MANIFEST}") as manifest:
        return json.loads(manifest.read())
