"""Registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions import paths as P
from veilscan.functions import text as T
from veilscan.functions.directives import parse_directive
from veilscan.functions.normalize import join_wrapped_base64, normalize
from veilscan.functions.placeholders import is_placeholder
from veilscan.functions.sizes import byte_size
from veilscan.operators import baseline as B
from veilscan.operators import score as S
from veilscan.operators.blocks import scan_blocks
from veilscan.operators.lines import cut_long_lines, to_lines
from veilscan.operators.match import keyword_candidates
from veilscan.operators.redact import redact, redact_texts
from veilscan.operators.segments import decode_texts
from veilscan.operators.structured import env_entries, json_leaves
from veilscan.plans.scan import scan_history, scan_lines, scan_texts, scan_tree
from veilscan.rules import Rule, compile_custom_rule, effective_rules, load_custom_rules
from veilscan.rules.remediation import with_remediation
from veilscan.sinks import reports as R
from veilscan.sinks.report_source import read_manifest, save_report
from veilscan.sinks.writers import write_baseline_json, write_findings
from veilscan.sources import tables as C
from veilscan.sources.baselines import read_baseline_json
from veilscan.sources.files import decode_bytes
from veilscan.sources.history import (
    COMMIT_MARKER,
    added_lines,
    file_diffs,
    history_lines,
    newest_commits,
    parse_commits,
    read_log,
)
from veilscan.sources.log_ranges import log_lines, read_log_line_stream, read_log_lines
from veilscan.sources.snapshots import changed_since, guard, pick_snapshot, staged
from veilscan.sources.tree import tree_contents, walk_tree
from veilscan.streaming import scan as streams

CUSTOM_RULES = [
    {"id": "doc-hex-token", "name": "Document token", "severity": "high",
     "regex": r'token\s*=\s*"([0-9a-f]{40})"', "keywords": ["token"], "minEntropy": 3},
    {"id": "page-tracker", "name": "Page tracker", "severity": "low",
     "regex": r"track\((\d+)\)", "keywords": ["track("]},
    {"id": "mail-address", "name": "Mail address", "severity": "low",
     "regex": r"\b[a-z0-9._]+@[a-z0-9-]+\.(?:com|org|net|example)\b", "keywords": ["@"]},
]
KEY_COLUMNS = ["path", "line", "column", "rule_id", "severity", "masked_value", "secret_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task scans.  Files of keys are small for the lines made out of them, so that their
#: splits, cut by size, would hold millions.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Use all cores, and tasks that stay short whatever the table's size.

    Tables that come in enough splits are left where they are.  Files tell their rows without being read.
    Rows are dealt by their place in the split: dealing in turn would have each split sorted first, in memory.
    """
    tasks = _tasks(df)
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks, F.monotonically_increasing_id())


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def custom_rules() -> list[Rule]:
    return [compile_custom_rule(d) for d in CUSTOM_RULES]


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.seeded_lines(spread(table(spark, sf_dir, "orders").select("o_orderkey")))


def seeded_findings(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Full scan of the seeded corpus: all rules, normalisation, three levels of decoding."""
    return scan_lines(seeded(spark, sf_dir), **options)


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        documents(spark, sf_dir)
        .unionByName(C.pages_corpus(table(spark, sf_dir, "pages")))
        .unionByName(C.conversations_corpus(table(spark, sf_dir, "conversations")))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.documents_corpus(table(spark, sf_dir, "documents"))


# -- rows derived from order keys ------------------------------------------------------------

def _keys(spark, sf_dir, name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """``k``, its MD5 ``h`` and an access key id ``ak``."""
    k = F.col(key)
    h = F.md5(k.cast("string").cast("binary"))
    return spread(table(spark, sf_dir, name).select(key)).select(
        k.alias("k"), h.alias("h"),
        F.concat(F.lit("AK"), F.lit("IA"), F.upper(F.substring(h, 1, 16))).alias("ak"))


def _pick(selector: Column, choices: list[Column]) -> Column:
    out = F.lit(None).cast("string")
    for i, choice in enumerate(choices):
        out = F.when(selector == i, choice).otherwise(out)
    return out


def disguised_lines(spark, sf_dir, *source: str) -> DataFrame:
    """Access key ids in fourteen disguises; normalisation must give ``key = <ak>`` for all."""
    df = _keys(spark, sf_dir, *source)
    ak = F.col("ak")
    head, tail = F.substring(ak, 1, 10), F.substring(ak, 11, 10)
    chars = F.split(ak, "")

    def each(fn, sep=""):
        return F.array_join(F.transform(chars, fn), sep)

    def lit(text):
        return F.lit(text)

    octal = each(lambda c: F.concat(lit("\\"), F.lpad(F.conv(F.ascii(c).cast("string"), 10, 8), 3, "0")))
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.concat(lit("'"), F.substring(ak, i * 2 + 1, F.lit(2)), lit("'")))
    shapes = [
        F.concat(lit("key = "), head, lit("​"), tail),
        F.concat(lit("key = String.fromCharCode("),
                 each(lambda c: F.ascii(c).cast("string"), ", "), lit(")")),
        F.concat(lit("key = "), head, lit("/* x */"), tail),
        F.concat(lit("key = "), head, lit("\" + '"), tail),
        F.concat(lit("key = "), each(lambda c: F.concat(lit("\\x"), F.lower(F.hex(F.ascii(c)))))),
        F.concat(lit("key = "), octal),
        F.concat(lit("key = "), each(lambda c: F.concat(lit("\\u00"), F.hex(F.ascii(c))))),
        F.concat(lit("key = "), each(lambda c: F.concat(lit("%"), F.hex(F.ascii(c))))),
        F.concat(lit("key = "), each(lambda c: F.concat(
            lit("&#"), F.ascii(c).cast("string"), lit(";")))),
        F.concat(lit("key = {{"), ak, lit("}}<%=-%>")),
        F.concat(lit("key = .format(x, '"), head, lit("', \""), tail, lit('")')),
        F.concat(lit("key = ["), F.array_join(pairs, ", "), lit("]")),
        F.concat(lit("key = "), F.array_join(chars, "-")),
        F.concat(lit("key = "), F.translate(ak, "B", "\u0412")),
    ]
    return df.select("k", "ak", (F.col("k") % 14).alias("kind"),
                     _pick(F.col("k") % 14, shapes).alias("text"))


def encoded_lines(spark, sf_dir, *source: str) -> DataFrame:
    """Access key ids encoded in nine ways, two of them twice."""
    ak = F.col("ak")
    once = F.base64(ak.cast("binary"))
    codes = F.transform(F.split(ak, ""), lambda c: F.ascii(c).cast("string"))
    shapes = [
        F.concat(F.lit("blob "), once),
        F.concat(F.lit("blob "), F.base64(once.cast("binary"))),
        F.concat(F.lit("blob "), F.lower(F.hex(ak))),
        F.concat(F.lit("blob "), F.hex(F.base64(ak.cast("binary")))),
        F.concat(F.lit("blob ["), F.array_join(codes, ","), F.lit("]")),
        F.concat(F.lit("blob "), F.reverse(ak)),
        F.concat(F.lit("blob "), F.array_join(F.transform(F.split(ak, ""), lambda c: F.concat(
            F.lit("%"), F.hex(F.ascii(c)))), "")),
        F.concat(F.lit("blob "), _base32(ak)),
        F.concat(F.lit("blob <~"), _ascii85(ak), F.lit("~>")),
    ]
    return _keys(spark, sf_dir, *source).select(
        "k", "ak", _pick(F.col("k") % 9, shapes).alias("text"))


def _base32(text: Column) -> Column:
    """Base32 of a text whose bytes are a multiple of five."""
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 5).cast("int") - 1),
                         lambda i: F.hex(F.substring(text, i * 5 + 1, F.lit(5))))
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 32), 8, "0")), "")
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _ascii85(text: Column) -> Column:
    """ASCII85 of a text whose bytes are a multiple of four."""
    groups = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(text) / 4).cast("int") - 1),
        lambda i: F.conv(F.hex(F.substring(text, i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    powers = F.array(*(F.lit(85 ** i).cast("long") for i in range(4, -1, -1)))
    return F.array_join(F.transform(groups, lambda n: F.array_join(F.transform(
        powers, lambda p: F.chr(F.lit(33) + F.floor(n / p) % 85)), "")), "")


def snapshots(spark, sf_dir) -> DataFrame:
    """Two snapshots of one file per order: some edited, added, deleted, linked or binary."""
    k, h, ak = F.col("k"), F.col("h"), F.col("ak")
    path = F.concat(
        F.when(k % 97 == 0, "src/../").otherwise("src/"), F.lit("f"), k.cast("string"),
        F.lit(".txt"))
    mode = F.when(k % 31 == 0, "120000").otherwise("100644")
    body = F.concat(F.lit("note "), h, F.lit("\n"), F.when(
        k % 17 == 0, F.concat(F.lit("id "), ak)).otherwise("plain"))
    edited = F.concat(body, F.when(k % 5 == 0, F.concat(F.lit("\nid "), ak)).otherwise(""))
    binary = F.when(k % 41 == 0, F.concat(edited, F.lit("\0\0\0\0"))).otherwise(edited)
    df = _keys(spark, sf_dir).select("k", path.alias("path"), mode.alias("mode"),
                                     body.alias("old"), binary.alias("new"))
    head = df.where("k % 11 <> 0").select(
        F.lit("head").alias("snapshot_id"), "path", "mode", F.col("old").alias("content"))
    index = df.where("k % 13 <> 0").select(
        F.lit("index").alias("snapshot_id"), "path", "mode", F.col("new").alias("content"))
    return head.unionByName(index)


def commit_blocks(spark, sf_dir) -> DataFrame:
    """One commit per order with two file diffs, a deletion and, now and then, a binary file."""
    k, h, ak = F.col("k"), F.col("h"), F.col("ak")
    s = k.cast("string")
    day = F.date_format(
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    binary = F.when(
        k % 9 == 0,
        "diff --git a/img.bin b/img.bin\nBinary files a/img.bin and b/img.bin differ\n").otherwise("")
    block = F.concat(
        F.lit(COMMIT_MARKER + "\0"), h, F.lit("\0Dev | "), (k % 5).cast("string"), F.lit("\0"), day,
        F.lit("T00:00:00+00:00\0\n\ndiff --git a/x b/x\nindex 1..2 100644\n--- a/src/a"),
        (k % 40).cast("string"), F.lit(".ts\n+++ b/src/a"), (k % 40).cast("string"),
        F.lit(".ts\n@@ -3,2 +"), (k % 100 + 1).cast("string"), F.lit(",3 @@ fn\n-old "), ak,
        F.lit("\n+id "), ak, F.lit("\n+++ plus "), s, F.lit("\n@@ -50 +"),
        (k % 100 + 60).cast("string"), F.lit(" @@\n+last "), h, F.lit("\n"), binary,
        F.lit("diff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"),
        F.lit("diff --git a/y b/y\n--- a/y.png\n+++ b/y"), s,
        F.when(k % 4 == 0, ".png").otherwise(".md"), F.lit("\n@@ -0,0 +1 @@\n+url postgres://u:"),
        F.substring(h, 1, 12), F.lit("@db/x\n"))
    return _keys(spark, sf_dir).select(block.alias("block"))


def config_files(spark, sf_dir) -> DataFrame:
    """A JSON, dotenv, broken JSON or text file per order."""
    k, h, ak = F.col("k"), F.col("h"), F.col("ak")
    path = F.concat(F.lit("conf/c"), k.cast("string"),
                    _pick(k % 4, [F.lit(".json"), F.lit(".env"), F.lit(".json"), F.lit(".txt")]))
    content = _pick(k % 4, [
        F.concat(F.lit('{"a":{"id":"'), ak, F.lit('","n":[1,"'), h, F.lit('",{"password":"'),
                 F.substring(h, 1, 14), F.lit('"}]},"t":true,"z":null}')),
        F.concat(F.lit("# comment\n\nID="), ak, F.lit("\nDB_PASSWORD=\""), F.substring(h, 1, 14),
                 F.lit("\"\nPLAIN\n X = 'y' ")),
        F.concat(F.lit('{"a": "'), ak),
        F.concat(F.lit("first\nid "), ak, F.lit("\nlast")),
    ])
    return _keys(spark, sf_dir).select(path.alias("path"), content.alias("content"))


def key_files(spark, sf_dir) -> DataFrame:
    """A file per order with a PEM block over several lines."""
    k, h = F.col("k"), F.col("h")
    content = F.concat(
        F.repeat(F.lit("intro\n"), (k % 3).cast("int")), F.lit("-----BEGIN RSA "),
        F.lit("PRIVATE KEY-----\n"), h, h, F.lit("\n"), F.reverse(h), h, F.lit("\n-----END RSA "),
        F.lit("PRIVATE KEY-----\nrest "), h)
    return _keys(spark, sf_dir).select(
        F.concat(F.lit("keys/k"), k.cast("string"), F.lit(".pem")).alias("path"),
        content.alias("content"))


# -- text preparation ---------------------------------------------------------------------------

def _digest(column: str) -> Column:
    return F.md5(F.col(column).cast("binary"))


def lines_documents(spark, sf_dir):
    lines = to_lines(documents(spark, sf_dir))
    return lines.select("path", "line", F.length("text").alias("n_chars"),
                        _digest("text").alias("text_md5"), _digest("prev_text").alias("prev_md5"))


def lines_pages(spark, sf_dir):
    lines = to_lines(C.pages_corpus(table(spark, sf_dir, "pages")))
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.max(F.length("text")).alias("longest"),
        F.sum(F.length("text")).alias("chars"))


def merged_lines(spark, sf_dir):
    lines = to_lines(text_corpus(spark, sf_dir), merge=True)
    return lines.select("path", "line", _digest("text").alias("text_md5"),
                        _digest("prev_text").alias("prev_md5"))


def long_line_chunks(spark, sf_dir):
    docs = spread(documents(spark, sf_dir))
    one_line = docs.select("path", F.translate("content", "\n", " ").alias("text"))
    return cut_long_lines(one_line, 4_096, 256).select(
        "path", "col_shift", F.length("text").alias("n_chars"), _digest("text").alias("text_md5"))


def wrapped_base64(spark, sf_dir):
    h = F.col("h")
    previous = F.base64(F.concat(h, F.when(F.col("k") % 3 == 0, "").otherwise(h)).cast("binary"))
    previous = F.regexp_replace(previous, r"\r\n", "")
    current = F.when(F.col("k") % 2 == 0, F.base64(h.cast("binary"))).otherwise(
        F.concat(h, F.lit("!")))
    return _keys(spark, sf_dir).select("k", join_wrapped_base64(current, previous).alias("text"))


def byte_sizes(spark, sf_dir):
    k = F.col("k")
    number = F.concat((k % 100).cast("string"), F.when(k % 2 == 0, ".5").otherwise(""))
    unit = _pick(k % 8, [F.lit(u) for u in ["B", "KB", " k", "mb", " M", "GB", "", "TB"]])
    literal = F.concat(number, unit)
    return _keys(spark, sf_dir).select("k", literal.alias("literal"),
                                       byte_size(literal).alias("bytes"))


def decoded_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    little, big = F.encode(text, "UTF-16LE"), F.encode(text, "UTF-16BE")
    body = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), little))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FEFF")), big))
        .otherwise(F.encode(text, "UTF-8"))
    )
    df = docs.select("doc_id", body.alias("content"))
    return df.select("doc_id", decode_bytes(F.col("content")).alias("_t")).select(
        "doc_id", F.length("_t").alias("n_chars"), F.md5(F.col("_t").cast("binary")).alias("text_md5"))


def env_file_entries(spark, sf_dir):
    files = config_files(spark, sf_dir).where(F.col("path").endswith(".env"))
    return files.select("path", F.explode(env_entries(F.col("content"))).alias("e")).select(
        "path", "e.line", "e.text")


def json_leaves_events(spark, sf_dir):
    """Leaves of a nested document around the payload of every event."""
    events = table(spark, sf_dir, "events")
    document = F.concat(
        F.lit('{"user":{"id":"u'), F.col("user_id").cast("string"), F.lit('","seen":["'),
        F.col("event_type"), F.lit('",{"deep":{"er":{"est":["x'),
        (F.col("event_id") % 7).cast("string"), F.lit('"]}}}]},"props":'), F.col("props"), F.lit("}"))
    df = json_leaves(events.select("event_id", document.alias("doc")), "doc")
    return df.select("event_id", F.explode_outer("leaves").alias("leaf")).where(
        "leaf IS NOT NULL").select("event_id", "leaf.key", "leaf.leaf_path", "leaf.value")


def structured_findings(spark, sf_dir):
    return scan_texts(config_files(spark, sf_dir), structured=True).select(
        *KEY_COLUMNS, "leaf_path")


# -- normalisation and decoding -----------------------------------------------------------------

def normalized_disguises(spark, sf_dir):
    return normalize(disguised_lines(spark, sf_dir), "text").select("k", "text")


def disguise_findings(spark, sf_dir):
    lines = disguised_lines(spark, sf_dir).select(
        F.lit("src/hidden.ts").alias("path"), F.col("k").alias("line"), "text")
    found = scan_lines(lines, effective_rules().only(["aws-access-key"]))
    return found.where("depth = 0").select("line", "column", "masked_value", "secret_hash")


def normalized_pages(spark, sf_dir):
    lines = to_lines(C.pages_corpus(table(spark, sf_dir, "pages"))).select("path", "line", "text")
    return normalize(lines, "text").select(
        "path", "line", F.length("text").alias("n_chars"), _digest("text").alias("text_md5"))


def decoded_keys(spark, sf_dir):
    """Decoded candidates that are access key ids, with depth, decoder and offset."""
    return decode_texts(encoded_lines(spark, sf_dir)).where(
        F.col("text").rlike(r"^AKIA[0-9A-F]{16}\z")).select("k", "depth", "codec", "text", "offset")


def decoded_findings(spark, sf_dir):
    lines = encoded_lines(spark, sf_dir).select(
        F.lit("src/encoded.ts").alias("path"), F.col("k").alias("line"), "text")
    # As they stand: normalisation would undo percent-encoding before any decoder sees it.
    found = scan_lines(lines, effective_rules().only(["aws-access-key"]), normalise=False)
    return found.select("line", "column", "depth", "masked_value", "secret_hash")


# -- matching and filters -----------------------------------------------------------------------

def keyword_gate(spark, sf_dir):
    """Rules that run on each seeded line."""
    return keyword_candidates(seeded(spark, sf_dir), effective_rules()).select(
        "path", "line", "rule_id")


def keyword_gate_texts(spark, sf_dir):
    """Lines per rule that pass its keyword gate, over documents, pages and conversations."""
    lines = to_lines(text_corpus(spark, sf_dir)).select("text")
    return keyword_candidates(lines, effective_rules()).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("lines"))


def scan_seeded(spark, sf_dir):
    return seeded_findings(spark, sf_dir).select(*KEY_COLUMNS, "depth")


def scan_text_tables(spark, sf_dir):
    """Documents, pages and conversations with all built-in and three custom rules."""
    rules = effective_rules(custom_rules())
    return scan_texts(text_corpus(spark, sf_dir), rules).select(*KEY_COLUMNS, "depth")


def custom_rule_findings(spark, sf_dir):
    rules = effective_rules(custom_rules(), builtin=[]).only(["doc-hex-token"])
    docs = spread(documents(spark, sf_dir))
    return scan_texts(docs, rules, decode_depth=0).select(*KEY_COLUMNS, "secret_sha")


def scan_events(spark, sf_dir):
    """Event payloads as JSON files, next to a rule for a short key."""
    rules = effective_rules([compile_custom_rule(
        {"id": "event-key", "name": "Event key", "regex": r'"k": (\d{2})\b', "severity": "low"})],
        builtin=[])
    events = C.events_corpus(table(spark, sf_dir, "events"))
    return scan_texts(events, rules).select(*KEY_COLUMNS)


def entropy_by_charset(spark, sf_dir):
    """Entropy, alphabet and mask of the longest word of every line of the seeded corpus."""
    word = F.regexp_extract("text", r"(\S+)\s*\z", 1)
    return seeded(spark, sf_dir).select("line", word.alias("w")).select(
        "line", F.round(T.shannon_entropy(F.col("w")), 6).alias("entropy"),
        T.charset(F.col("w")).alias("charset"),
        T.is_high_entropy(F.col("w"), T.rounded_entropy(F.col("w"))).alias("high"),
        T.mask(F.col("w")).alias("masked"))


def path_filters(spark, sf_dir):
    """Skip and test-path decisions for invented paths, one per document and page."""
    extensions = [".png", ".ts", ".MD", ".tar", ".woff2", ".spec.js", ".zip", ".min.js"]
    ending = _pick(F.col("id") % 8, [F.lit(e) for e in extensions])
    folder = _pick(F.col("id") % 6, [
        F.lit(f) for f in ["src/", "node_modules/x/", "a/tests/", "lib\\fixtures\\", "vendor/", ""]])
    name = F.when(F.col("id") % 29 == 0, F.lit("yarn.lock")).otherwise(
        F.concat(F.lit("f"), F.col("id").cast("string"), ending))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).unionAll(
        table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000).alias("id")))
    df = ids.select("id", F.concat(folder, name).alias("path"))
    path = F.col("path")
    return df.select(
        "id", "path", P.in_excluded_directory(path).alias("in_excluded_directory"),
        P.is_excluded_file(path).alias("excluded_file"),
        P.matches_ignore(path, ["vendor", "**/lib/**", "*.zip"]).alias("user_ignored"),
        P.is_test_or_doc(path).alias("test_or_doc"))


def placeholder_values(spark, sf_dir):
    """Placeholder decision for word-derived values in source and test paths."""
    words = _pick(F.col("kind"), [F.lit(w) for w in [
        "", "change_me", "Example", "test", "xxxx", "e.g. ", "dummy", "your-token", "aaaaaaaa", "todo"]])
    value = F.when(F.col("line") % 4 == 0, words).otherwise(
        F.concat(words, F.substring(F.md5(F.col("text").cast("binary")), 1, 8)))
    return seeded(spark, sf_dir).withColumn("value", value).select(
        "path", "line", "value", is_placeholder(F.col("value"), F.col("path")).alias("placeholder"))


def directives(spark, sf_dir):
    """Inline comments of every style, parsed."""
    styles = ["// scan:ignore", "# scan:ignore aws-access-key", "-- SCAN:IGNORE [npm-token, jwt]",
              "/* scan:ignore x y */", "<!-- scan:ignore -->", "// scan:ignore-next-line jwt",
              "scan:ignore", "// scan : ignore"]
    lines = _keys(spark, sf_dir).select(
        "k", F.concat(F.col("h"), F.lit(" "), _pick(F.col("k") % 8, [F.lit(s) for s in styles]))
        .alias("text"))
    here = parse_directive(F.col("text"), "ignore")
    below = parse_directive(F.col("text"), "ignore-next-line")
    return lines.select(
        "k", here["all"].alias("here_all"), F.array_join(here["rules"], "|").alias("here_rules"),
        below["all"].alias("below_all"), F.array_join(below["rules"], "|").alias("below_rules"))


def silenced_findings(spark, sf_dir):
    """Findings that survive comments on their line and on the line before it."""
    k, ak = F.col("k"), F.col("ak")
    comment = _pick(k % 4, [F.lit(""), F.lit(" // scan:ignore aws-access-key"),
                            F.lit(" // scan:ignore npm-token"), F.lit(" # scan:ignore")])
    before = _pick(k % 3, [F.lit("code"), F.lit("// scan:ignore-next-line"),
                           F.lit("# scan:ignore-next-line aws-access-token")])
    content = F.concat(before, F.lit("\nid = "), ak, comment)
    files = _keys(spark, sf_dir).select(
        F.concat(F.lit("src/d"), k.cast("string"), F.lit(".ts")).alias("path"),
        content.alias("content"))
    rules = effective_rules().only(["aws-access-key", "npm-token"])
    return scan_texts(files, rules).select("path", "line", "rule_id", "column")


def allowlisted_findings(spark, sf_dir):
    """Findings left after an allowlist of every third key, half by value and half by hash."""
    keys = _keys(spark, sf_dir).where("k % 3 = 0")
    entry = F.when(F.col("k") % 2 == 0, F.col("ak")).otherwise(F.sha2(F.col("ak"), 256))
    entries = keys.select(F.concat(F.lit(" "), entry).alias("entry"))
    rules = effective_rules().only(["aws-access-key"])
    return scan_lines(seeded(spark, sf_dir), rules, allowlist=entries).select(*KEY_COLUMNS, "depth")


def severe_findings(spark, sf_dir):
    """Only critical rules, with one of them switched off."""
    rules = effective_rules(toggles={"npm-token": False}, min_severity="critical")
    return scan_lines(seeded(spark, sf_dir), rules).select(*KEY_COLUMNS, "depth")


def block_findings(spark, sf_dir):
    return scan_blocks(key_files(spark, sf_dir)).select(
        "path", "line", "column", "rule_id", "masked_value", "secret_hash")


# -- texts that cross former limits, engines, marks within lines ---------------------------------

def long_files(spark, sf_dir) -> DataFrame:
    """A file per supplier: a line of over 65,000 characters, a Base64 text of 25,000 or a JSON
    document of over 70,000, with an access key id."""
    s = F.col("s_suppkey")
    ak = F.concat(F.lit("AK"), F.lit("IA"), F.upper(
        F.substring(F.md5(s.cast("string").cast("binary")), 1, 16)))
    note = F.concat(F.repeat(F.lit("note "), 3_000), F.lit("id "), ak, F.repeat(F.lit(" end"), 1_000))
    files = F.array(
        F.struct(F.concat(F.lit("long"), s, F.lit(".txt")).alias("path"), F.concat(
            F.repeat(F.lit("x "), (s % 200 + 32_600).cast("int")), ak, F.lit(" y")).alias("content")),
        F.struct(F.concat(F.lit("blob"), s, F.lit(".txt")).alias("path"), F.concat(
            F.lit("blob "), F.translate(F.base64(note.cast("binary")), "\r\n", "")).alias("content")),
        F.struct(F.concat(F.lit("long"), s, F.lit(".json")).alias("path"), F.concat(
            F.lit('{"pad":["'), F.repeat(F.lit("x "), 35_000), F.lit('"],"deep":{"id":"'), ak,
            F.lit('"}}')).alias("content")))
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(
        F.get(files, (s % 3).cast("int")).alias("f")).select("f.*")


def long_text_findings(spark, sf_dir):
    """The planted keys of the long files, found by a scan with all rules."""
    found = scan_texts(long_files(spark, sf_dir), structured=True)
    return found.where("rule_id = 'aws-access-key'").select(
        "path", "line", "column", "depth", "leaf_path", "masked_value", "secret_hash")


def text_block_findings(spark, sf_dir):
    """Keys over several lines, found by the ordinary scan of texts with all rules."""
    return scan_texts(key_files(spark, sf_dir)).where("codec = 'block'").select(
        "path", "line", "column", "rule_id", "masked_value", "secret_hash")


def engines_agree(spark, sf_dir):
    """A rule without keywords and with a multi-line flag, under both screens."""
    rules = effective_rules([compile_custom_rule(
        {"id": "corp-tag", "name": "Tag", "regex": "/^corp-[a-z]{4}$/m", "severity": "low"})], builtin=[])
    tag = F.translate(F.substring("h", 1, 4), "0123456789", "ghijklmnop")
    lines = _keys(spark, sf_dir).select(
        F.lit("a.txt").alias("path"), F.col("k").alias("line"),
        F.concat(F.lit("one\ncorp-"), tag, F.lit("\ntwo")).alias("text"))
    found = [
        scan_lines(lines, rules, engine=engine).select(
            F.lit(engine).alias("engine"), "line", "column", "secret_hash")
        for engine in ("arrow", "jvm")]
    return found[0].unionByName(found[1])


def marked_commits(spark, sf_dir) -> DataFrame:
    """A commit per order that adds a line with the commit marker in it, and then a key."""
    k, s = F.col("k"), F.col("k").cast("string")
    return _keys(spark, sf_dir).select(F.concat(
        F.lit(COMMIT_MARKER + "\0"), "h", F.lit("\0Dev\0" + "2024-01-01T00:00:00+00:00\0\n\n"),
        F.lit("diff --git a/m b/m\n--- a/m\n+++ b/src/m"), (k % 5).cast("string"),
        F.lit(".ts\n@@ -0,0 +1,2 @@\n+const M"), s, F.lit(f" = '{COMMIT_MARKER}'\n+id "), "ak",
        F.lit("\n")).alias("block"))


def _marked_log(spark, sf_dir) -> str:
    folder = f"{_work_folder(spark)}/log"
    marked_commits(spark, sf_dir).write.text(folder)
    return folder


def history_marker_lines(spark, sf_dir):
    """A written log whose lines hold the marker, read back and scanned with all rules."""
    found = scan_history(read_log(spark, _marked_log(spark, sf_dir)))
    return found.where("rule_id = 'aws-access-key'").select(
        "commit", "path", "line", "column", "masked_value", "secret_hash")


def stream_history_findings(spark, sf_dir):
    """The same log as a stream of commit blocks."""
    blocks = streams.read_log_stream(spark, _marked_log(spark, sf_dir))
    found = streams.stream_history(blocks).where("rule_id = 'aws-access-key'")
    return _run_stream(spark, found.select(
        "commit", "path", "line", "column", "masked_value", "secret_hash"))


def written_baseline(spark, sf_dir):
    """The fingerprints of the seeded corpus, written as JSON documents and read back."""
    folder = f"{_work_folder(spark)}/baseline"
    write_baseline_json(seeded_findings(spark, sf_dir), folder)
    return read_baseline_json(spark, folder)


# -- analytics over findings --------------------------------------------------------------------

def severity_counts(spark, sf_dir):
    return S.severity_counts(seeded_findings(spark, sf_dir))


def score_report(spark, sf_dir):
    report = S.score_report(seeded_findings(spark, sf_dir))
    return report.select("score", "tier", F.col("counts.critical").alias("critical"),
                         F.col("counts.high").alias("high"), F.col("counts.medium").alias("medium"),
                         F.col("counts.low").alias("low"))


def findings_per_severity(spark, sf_dir):
    return S.findings_per_severity(seeded_findings(spark, sf_dir))


def findings_per_file(spark, sf_dir):
    return S.findings_per_file(seeded_findings(spark, sf_dir))


def top_findings(spark, sf_dir):
    return S.first_findings(seeded_findings(spark, sf_dir)).select(*KEY_COLUMNS)


def distinct_findings(spark, sf_dir):
    return S.distinct_findings(seeded_findings(spark, sf_dir)).select(
        "path", "line", "rule_id", "secret_hash", "depth", "column")


def secret_reuse(spark, sf_dir):
    """Spread of secrets when the seeded corpus is copied to a second folder."""
    lines = seeded(spark, sf_dir)
    copies = lines.unionByName(
        lines.where("line % 2 = 0").withColumn("path", F.concat(F.lit("copy/"), "path")))
    return S.secret_reuse(scan_lines(copies))


def _baseline(spark, sf_dir):
    """Findings on even lines are accepted."""
    return B.baseline_entries(seeded_findings(spark, sf_dir).where("line % 2 = 0"))


def baseline_entries(spark, sf_dir):
    return _baseline(spark, sf_dir)


def baseline_active(spark, sf_dir):
    return B.active_findings(
        seeded_findings(spark, sf_dir), _baseline(spark, sf_dir)).select(*KEY_COLUMNS)


def baseline_suppressed(spark, sf_dir):
    return B.suppressed_findings(
        seeded_findings(spark, sf_dir), _baseline(spark, sf_dir)).select(*KEY_COLUMNS)


def verified_findings(spark, sf_dir):
    """Findings with the verdicts on keys of orders divisible by four or five."""
    ak = F.col("ak")
    verdicts = _keys(spark, sf_dir).where("k % 20 IN (0, 4, 5, 8, 10, 12, 15, 16)").select(
        F.sha2(ak, 256).alias("secret_sha"), (F.col("k") % 4 == 0).alias("verified"))
    found = B.with_verdicts(seeded_findings(spark, sf_dir), verdicts)
    return found.select("path", "line", "rule_id", "column", "verified")


def scan_summary(spark, sf_dir):
    files = seeded(spark, sf_dir).select("path", F.col("text").alias("content"))
    totals = S.file_totals(files.withColumn("status", F.lit("scanned")))
    return S.summary(totals, seeded_findings(spark, sf_dir), _baseline(spark, sf_dir))


def finding_remediation(spark, sf_dir):
    rules = effective_rules()
    found = with_remediation(seeded_findings(spark, sf_dir), rules)
    return found.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("findings"), F.max(F.size("steps")).alias("steps"))


# -- snapshots and history ----------------------------------------------------------------------

def snapshot_changes(spark, sf_dir):
    both = snapshots(spark, sf_dir)
    changed = changed_since(pick_snapshot(both, "index"), pick_snapshot(both, "head"))
    return guard(changed, "1MB").select("path", "status", _digest("content").alias("content_md5"))


def staged_findings(spark, sf_dir):
    files = guard(staged(snapshots(spark, sf_dir))).where("status = 'scanned'")
    rules = effective_rules().only(["aws-access-key"])
    return scan_texts(files, rules).select(*KEY_COLUMNS)


def history_added_lines(spark, sf_dir):
    lines = history_lines(commit_blocks(spark, sf_dir))
    return lines.select("commit", "commit_author", "commit_date", "path", "line", "text")


def history_findings(spark, sf_dir):
    rules = effective_rules().only(["aws-access-key", "db-connection-string"])
    found = scan_history(commit_blocks(spark, sf_dir), rules, ignore=["a7.ts"])
    return found.select("commit", "commit_author", "commit_date", "path", "line", "column",
                        "rule_id", "masked_value", "secret_hash")


def history_totals(spark, sf_dir):
    commits = parse_commits(commit_blocks(spark, sf_dir))
    diffs = file_diffs(commits)
    return S.history_totals(added_lines(diffs), diffs, commits)


def history_newest(spark, sf_dir):
    commits = newest_commits(parse_commits(commit_blocks(spark, sf_dir)), 100)
    return added_lines(file_diffs(commits), "40B").select("commit", "path", "line", "text")


def _numbered_log(spark, sf_dir) -> DataFrame:
    """The lines ``value`` of the log, in the order ``commit, pos``."""
    blocks = commit_blocks(spark, sf_dir).select(
        F.split_part("block", F.lit("\0"), F.lit(2)).alias("commit"),
        F.regexp_replace("block", r"\n\z", "").alias("block"))
    return blocks.select("commit", F.posexplode(F.split("block", "\n")).alias("pos", "value"))


def _write_log(lines: DataFrame, folder: str) -> str:
    """Files that end anywhere, also within a commit or a hunk; their names are in order."""
    files = max(16, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines.repartitionByRange(files, "commit", "pos").sortWithinPartitions("commit", "pos").select(
        "value").write.text(folder)
    return folder


def _cut_log(spark, sf_dir) -> DataFrame:
    return read_log_lines(spark, _write_log(_numbered_log(spark, sf_dir), f"{_work_folder(spark)}/log"))


def history_cut_lines(spark, sf_dir):
    """Added lines of the log whose commits are cut by the ends of files."""
    lines = log_lines(_cut_log(spark, sf_dir), _work_folder(spark))
    return lines.select("commit", "commit_author", "commit_date", "path", "line", "text")


def history_cut_findings(spark, sf_dir):
    """The same log, scanned."""
    rules = effective_rules().only(["aws-access-key", "db-connection-string"])
    lines = log_lines(_cut_log(spark, sf_dir), _work_folder(spark), ignore=["a7.ts"])
    return scan_lines(lines, rules, extra=["commit", "commit_author", "commit_date"]).select(
        "commit", "commit_author", "commit_date", "path", "line", "column", "rule_id", "masked_value", "secret_hash")


def stream_cut_lines(spark, sf_dir):
    """The same log as a stream whose second batch begins within a commit."""
    folder = _work_folder(spark)
    lines = _numbered_log(spark, sf_dir)
    cut = lines.where("commit >= '8'").agg(F.min("commit")).head()[0]
    late = lines.withColumn("late", F.coalesce(
        (F.col("commit") > cut) | ((F.col("commit") == cut) & (F.col("pos") >= 12)), F.lit(False)))
    for half in (False, True):
        _write_log(late.where(F.col("late") == half), f"{folder}/log/half={int(half)}")
        streams.write_log_lines(
            read_log_line_stream(spark, f"{folder}/log"), folder, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/lines").select(
        "commit", "commit_author", "commit_date", "path", "line", "text")


def history_one_file(spark, sf_dir):
    """The added lines of a single file."""
    lines = history_lines(commit_blocks(spark, sf_dir), only_file="src/a7.ts")
    return lines.select("commit", "path", "line", "text")


# -- folder trees and archives ------------------------------------------------------------------

def _write_tree(spark, sf_dir) -> str:
    """A file for each customer's key in a shared folder: plain, hidden, wide, large, linked, in an archive,
    in a folder that is not entered, or with an archive's name."""
    root = f"{_work_folder(spark)}/tree"

    def write(table):
        import io
        import os
        import zipfile

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)

        def put(path, body):
            system.create_dir(f"{base}/{path.rsplit('/', 1)[0]}", recursive=True)
            with system.open_output_stream(f"{base}/{path}", compression=None) as out:
                out.write(body)

        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("m/bad.txt", "unread " * 50)
            for k, ak in zip(table["k"].to_pylist(), table["ak"].to_pylist()):
                text = "id " + ak
                if k % 8 == 0:
                    put(f"src/d{k % 50}/f{k}.ts", text.encode())
                elif k % 8 == 1:
                    put(f".cfg/f{k}.txt", text.encode())
                elif k % 8 == 2:
                    put(f"u/f{k}.txt", ("\ufeff" + text).encode("utf-16-le"))
                elif k % 8 == 3:
                    put(f"big/f{k}.txt", (text + "x" * 3_000).encode())
                elif k % 8 == 4:
                    put(f"kept/f{k}.txt", text.encode())
                    os.makedirs(f"{base}/links", exist_ok=True)
                    if not os.path.islink(f"{base}/links/f{k}.txt"):  # a task may run again
                        os.symlink(f"{base}/kept/f{k}.txt", f"{base}/links/f{k}.txt")
                elif k % 8 == 5:
                    archive.writestr(f"m/f{k}.txt", text)
                elif k % 8 == 6:
                    put(f"lib/node_modules/f{k}.ts", text.encode())
                else:
                    put(f"bad/f{k}.zip", text.encode())
        body = bytearray(packed.getvalue())
        at = 30 + len("m/bad.txt")
        body[at:at + 8] = b"\xff" * 8
        put(f"arc/a{table['g'][0].as_py()}.zip", bytes(body))
        return table.select(["k"])

    keys = _keys(spark, sf_dir, "customer", "c_custkey").withColumn("g", F.expr("k div 80"))
    keys.groupBy("g").applyInArrow(write, "k bigint").agg(F.count("k")).collect()
    return root


def tree_files(spark, sf_dir):
    """All files of the tree and why they are scanned or not; members of archives with their own rows."""
    root, folder = _write_tree(spark, sf_dir), _work_folder(spark)
    listed = _written(walk_tree(spark, root, f"{folder}/listing", ignore=["kept"], max_file_size="2KB"))
    read = tree_contents(listed, root, f"{folder}/members")
    return read.select("path", "status", F.octet_length("content").cast("bigint").alias("length")).unionByName(
        listed.where("status <> 'scanned'").select("path", "status", "length"))


def tree_findings(spark, sf_dir):
    """The tree scanned with all rules."""
    root, folder = _write_tree(spark, sf_dir), _work_folder(spark)
    return scan_tree(spark, root, folder, ignore=["kept"], max_file_size="2KB").select(*KEY_COLUMNS)


# -- rules files and findings tables ------------------------------------------------------------

def rules_file_findings(spark, sf_dir):
    """Rules from a file over all documents: they replace custom rules of the same id, never built-in ones."""
    folder = f"{_work_folder(spark)}/rules"
    listed = [*CUSTOM_RULES, {"id": "jwt", "name": "Not the token", "regex": "the", "severity": "low", "keywords": ["the"]}]
    spark.createDataFrame([(json.dumps({"customRules": listed}),)], "value string").coalesce(1).write.text(folder)
    weaker = compile_custom_rule(CUSTOM_RULES[0] | {"regex": r"token\s*=\s*(\w)", "severity": "low"})
    builtin = effective_rules().only(["jwt"]).rules
    rules = effective_rules([weaker], load_custom_rules(spark, folder), builtin=builtin).only(["doc-hex-token", "jwt"])
    return scan_texts(documents(spark, sf_dir), rules).select(*KEY_COLUMNS)


def written_findings(spark, sf_dir):
    """The findings of the seeded corpus as a table by severity, read back."""
    folder = f"{_work_folder(spark)}/findings"
    write_findings(seeded_findings(spark, sf_dir), folder)
    return spark.read.parquet(folder).select(*KEY_COLUMNS, "depth")


# -- reports ------------------------------------------------------------------------------------

def _report(fragments: DataFrame) -> DataFrame:
    return fragments.select("path", "line", "rule_ord", "column", "fragment")


def report_json(spark, sf_dir):
    return _report(R.json_findings(seeded_findings(spark, sf_dir)))


def report_sarif(spark, sf_dir):
    return _report(R.sarif_results(seeded_findings(spark, sf_dir)))


def report_sarif_history(spark, sf_dir):
    rules = effective_rules().only(["aws-access-key"])
    return _report(R.sarif_results(scan_history(commit_blocks(spark, sf_dir), rules)))


def report_quality(spark, sf_dir):
    return _report(R.quality_issues(seeded_findings(spark, sf_dir)))


def report_junit(spark, sf_dir):
    return R.junit_rows(seeded_findings(spark, sf_dir)).select(
        "path", "part", "line", "rule_ord", "column", "fragment")


def report_annotations(spark, sf_dir):
    return _report(R.annotations(seeded_findings(spark, sf_dir)))


def report_markdown(spark, sf_dir):
    return R.markdown_table(seeded_findings(spark, sf_dir)).select("fragment")


def _read_sarif(documents: DataFrame) -> DataFrame:
    region = "struct<startLine:bigint,startColumn:bigint>"
    place = f"struct<artifactLocation:struct<uri:string>,region:{region}>"
    result = ("struct<ruleId:string,partialFingerprints:struct<secretHash:string>,"
              f"locations:array<struct<physicalLocation:{place}>>>")
    log = F.from_json("value", f"struct<runs:array<struct<results:array<{result}>>>>")
    at = F.col("r.locations")[0]["physicalLocation"]
    return documents.select(F.explode(log["runs"][0]["results"]).alias("r")).select(
        at["artifactLocation"]["uri"].alias("path"), at["region"]["startLine"].alias("line"),
        at["region"]["startColumn"].alias("column"), F.col("r.ruleId").alias("rule_id"),
        F.col("r.partialFingerprints.secretHash").alias("detail"))


def _read_quality(documents: DataFrame) -> DataFrame:
    issue = ("struct<check_name:string,fingerprint:string,"
             "location:struct<path:string,lines:struct<begin:bigint>>>")
    return documents.select(F.explode(F.from_json("value", f"array<{issue}>")).alias("r")).select(
        "r.location.path", F.col("r.location.lines.begin").alias("line"), F.lit(None).cast("bigint").alias("column"),
        F.col("r.check_name").alias("rule_id"), F.col("r.fingerprint").alias("detail"))


def _read_json(documents: DataFrame) -> DataFrame:
    item = "struct<rule:string,file:string,line:bigint,column:bigint,maskedValue:string>"
    report = F.from_json("value", f"struct<findings:array<{item}>>")
    return documents.select(F.explode(report["findings"]).alias("r")).select(
        F.col("r.file").alias("path"), "r.line", "r.column", F.col("r.rule").alias("rule_id"),
        F.col("r.maskedValue").alias("detail"))


def _read_junit(documents: DataFrame) -> DataFrame:
    """Cases below the suite of their file, whose stated number is the detail."""
    suites = documents.select(F.explode(F.regexp_extract_all(
        "value", F.lit(r"(?s)(<testsuite .*?</testsuite>)"), 1)).alias("suite"))
    # Read before the cases are dealt out: for each of them it would read a suite of megabytes again.
    suites = suites.withColumn("n", F.regexp_extract("suite", r'tests="(\d+)"', 1))
    case = r'(?s)<testcase classname="([^"]*)" name="[^"]* at line (\d+):(\d+)".*?\(([^()"]*)\)" type='
    cases = F.arrays_zip(*[F.regexp_extract_all("suite", F.lit(case), i).alias(n) for i, n in enumerate(
        ("path", "line", "column", "rule_id"), 1)])
    return suites.select(F.explode(cases).alias("r"), "n").select(
        "r.path", F.col("r.line").cast("bigint").alias("line"), F.col("r.column").cast("bigint").alias("column"),
        "r.rule_id",
        F.col("n").alias("detail"))


def written_reports(spark, sf_dir):
    """The findings of the seeded corpus written in four formats and read back, with the stated totals."""
    found = _written(seeded_findings(spark, sf_dir))
    readers = {"sarif": _read_sarif, "quality": _read_quality, "json": _read_json, "junit": _read_junit}
    frames = []
    for kind, reader in readers.items():
        folder = f"{_work_folder(spark)}/report"
        save_report(found, folder, kind, findings_per_file=1_000)
        frames.append(reader(spark.read.text(folder, wholetext=True)).withColumn("kind", F.lit(kind)))
        total = read_manifest(folder)["findings"]
        frames.append(spark.createDataFrame(
            [(None, total, None, None, None, f"{kind} total")],
            "path string, line bigint, column bigint, rule_id string, detail string, kind string"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def redacted_documents(spark, sf_dir):
    """Documents with every document token masked."""
    docs = spread(documents(spark, sf_dir))
    rules = effective_rules(custom_rules(), builtin=[]).only(["doc-hex-token"])
    found = scan_texts(docs, rules, decode_depth=0, keep_secret=True)
    return redact(docs, found).select(
        "path", F.length("content").alias("n_chars"), _digest("content").alias("content_md5"))


def hidden_files(spark, sf_dir) -> DataFrame:
    """Two files of three lines for each customer's key, disguised and encoded, in the second line.

    ``sure`` is false for ASCII85, whose alphabet holds what normalisation rewrites.
    """
    source = ("customer", "c_custkey")
    lines = disguised_lines(spark, sf_dir, *source).select(
        F.concat(F.lit("src/d"), "k", F.lit(".ts")).alias("path"), "ak", "text", F.lit(True).alias("sure")).unionByName(
        encoded_lines(spark, sf_dir, *source).select(
            F.concat(F.lit("src/e"), "k", F.lit(".ts")).alias("path"), "ak", "text", (F.col("k") % 9 != 8).alias("sure")))
    return lines.select("path", "ak", "sure", F.concat(F.lit("before\r\n  "), "text", F.lit(" \nafter")).alias("content"))


def _written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back."""
    path = f"{_work_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def redacted_secrets(spark, sf_dir):
    """Disguised and encoded keys, found by all rules, masked at their source and scanned again."""
    files = hidden_files(spark, sf_dir)
    # Findings and the redacted corpus are each used more than once, and made once.
    found = _written(scan_texts(files.select("path", "content"), keep_secret=True))
    clean = _written(redact_texts(files, found))
    again = scan_texts(clean.select("path", "content")).groupBy("path").agg(F.count("*").alias("left"))
    return clean.join(again, "path", "left").select(
        "path", F.coalesce("left", F.lit(0)).cast("long").alias("findings_left"),
        F.contains("content", "ak").alias("key_left"),
        F.regexp_extract("content", r"(?s)^(before\r\n  [a-z]+).*( \nafter)\z", 1).alias("head"),
        (F.col("content").contains("***") | ~F.col("sure")).alias("masked"))


# -- streaming ----------------------------------------------------------------------------------

def _work_folder(spark) -> str:
    """A fresh folder below the shared checkpoint folder (a local one only where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    return f"{base or tempfile.mkdtemp(prefix='veilscan-')}/stream-{uuid.uuid4().hex}"


def _stream_table(spark, sf_dir, name) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run_stream(spark, stream: DataFrame) -> DataFrame:
    folder = _work_folder(spark)
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_findings(spark, sf_dir):
    """The documents as a stream, scanned with the document token rule."""
    rules = effective_rules(custom_rules(), builtin=[]).only(["doc-hex-token"])
    docs = C.documents_corpus(_stream_table(spark, sf_dir, "documents"))
    return _run_stream(spark, streams.stream_texts(docs, rules, decode_depth=0).select(*KEY_COLUMNS))


def stream_active_findings(spark, sf_dir):
    """The seeded corpus as a stream, without the findings of a static baseline."""
    # A stream does not know the place of a row in its split: keys are dealt in turn.
    keys = _stream_table(spark, sf_dir, "orders").select("o_orderkey").repartition(
        _tasks(table(spark, sf_dir, "orders")))
    # The baseline is a table: scanned once, not again for each batch, nor as a part of the stream's plan.
    found = streams.drop_known(streams.stream_lines(C.seeded_lines(keys)), _written(_baseline(spark, sf_dir)))
    return _run_stream(spark, found.select(*KEY_COLUMNS))


def _repeated_stream(spark, sf_dir) -> DataFrame:
    """The seeded corpus as a stream of two batches, the second with the same files again."""
    folder = f"{_work_folder(spark)}/lines"
    lines = seeded(spark, sf_dir)
    for part in range(2):
        lines.write.parquet(f"{folder}/part={part}")
    batch = max(1, len(spark.read.schema(lines.schema).parquet(f"{folder}/part=0").inputFiles()))
    return spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", batch).option(
        "recursiveFileLookup", True).parquet(folder)


def stream_first_findings(spark, sf_dir):
    """Each finding of the repeated stream once, known by its fingerprint."""
    folder = _work_folder(spark)
    streams.report_once(
        streams.stream_lines(_repeated_stream(spark, sf_dir)).select(*KEY_COLUMNS), f"{folder}/out",
        f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("fingerprint", "rule_id", "path")


def stream_totals(spark, sf_dir):
    """Findings and distinct files by severity, over both batches of the repeated stream."""
    folder = _work_folder(spark)
    streams.write_totals(
        streams.stream_lines(_repeated_stream(spark, sf_dir)), f"{folder}/totals",
        f"{folder}/checkpoint").awaitTermination()
    return streams.read_totals(spark, f"{folder}/totals").withColumnRenamed("path", "files")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_seeded(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    chosen = [
        lines_documents, lines_pages, merged_lines, long_line_chunks, wrapped_base64, byte_sizes,
        decoded_bytes, env_file_entries, json_leaves_events, structured_findings,
        normalized_disguises, disguise_findings, normalized_pages, decoded_keys, decoded_findings,
        keyword_gate, keyword_gate_texts, scan_seeded, scan_text_tables, custom_rule_findings,
        scan_events, entropy_by_charset, path_filters, placeholder_values, directives,
        silenced_findings, allowlisted_findings, severe_findings, block_findings, severity_counts,
        score_report, findings_per_severity, findings_per_file, top_findings, distinct_findings,
        secret_reuse, baseline_entries, baseline_active, baseline_suppressed, verified_findings,
        scan_summary, finding_remediation, snapshot_changes, staged_findings, history_added_lines,
        history_findings, history_totals, history_newest, report_json, report_sarif,
        report_sarif_history, report_quality, report_junit, report_annotations, report_markdown,
        redacted_documents, stream_findings, stream_active_findings, long_text_findings,
        text_block_findings, engines_agree, history_marker_lines, stream_history_findings,
        written_baseline, redacted_secrets, stream_first_findings, stream_totals,
        history_cut_lines, history_cut_findings, stream_cut_lines, history_one_file, tree_files,
        tree_findings, rules_file_findings, written_findings, written_reports,
    ]
    return {fn.__name__: fn for fn in chosen}
