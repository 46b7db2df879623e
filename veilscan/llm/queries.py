"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import byte_bpe, nbsvm, page_text
from veilscan.llm.chat import format_chats, read_chats
from veilscan.llm.common import materialize, table
from veilscan.llm.fingerprints import compare_with_next
from veilscan.llm.jaccard_join import near_duplicates
from veilscan.llm.licenses import base_rule, default_rules, scan_licenses, summary
from veilscan.llm.neighbours import nearest
from veilscan.llm.packing import cut_pieces, pack
from veilscan.llm.periodic_runs import find_runs, with_repeats
from veilscan.llm.pseudonyms import pseudonymize
from veilscan.llm.spelling import count_words, variants
from veilscan.llm.url_filters import UrlRule, filter_urls

URL_RULES = [
    UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"),
]


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of linked documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.with_length(page_text.extract(pages, page_text.train()).drop("html"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's quality score, learnt from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model).select(
        "doc_id", (nbsvm.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict.  A page's outcome is that of the label with its number: bad if it is
    of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1)
        .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, labels, URL_RULES)


#: A run's own secret takes its place in production.
PSEUDONYM_KEY = "veilscan-pseudonym-key"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal values replaced, and how many of each kind."""
    docs = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return docs.select("doc_id", "text", F.size("pii").alias("n_values"),
                       F.array_join(F.transform("pii", lambda p: p["kind"]), " ").alias("kinds"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose number is divisible by 20, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def pieces_of(docs: DataFrame) -> DataFrame:
    """All pieces with the CRC of their ids instead of the ids."""
    cut = cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)
    return cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4,096 tokens."""
    return pack(pieces_of(table(spark, sf_dir, "documents")))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's digest, against its edited text's and the next document's."""
    return compare_with_next(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, read back from the formatted tree."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    made = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    tree = materialize(format_chats(turns.unionByName(made), vocabulary), "chats")
    chats = read_chats(tree, vocabulary)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form and root; one pair of document and word in 31 is
    misspelt beforehand."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(count_words(docs, edit_share=31)).select("word", "form", "root", "n", "n_near", "form_n")


LICENSE_PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"),
                   ("mit", "mit license")]


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's license detections, as counts and labels."""
    rules = default_rules() + [base_rule(*phrase) for phrase in LICENSE_PHRASES]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(scan_licenses(docs, rules).drop("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's runs, and its text without repeats, as digests; a tenth of the documents
    is made to repeat beforehand."""
    docs = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs).select("doc_id", "runs", "collapsed")
    # The longest run, then the smallest start and period.
    top = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"),
        (-F.col("top.order")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.order") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pseudonyms, op2_nearest_neighbours, op3_byte_bpe, op4_ngram_jaccard_join,
             op5_html_extraction, op6_quality_classifier, op7_url_filters, op8_best_fit_packing,
             op9_document_fingerprints, op10_chat_formatting, op11_spelling_variants, op12_license_scans,
             op13_periodic_runs]
    return {f.__name__: f for f in found}


def llm_oracles() -> dict[str, str]:
    from veilscan.llm.oracles import ORACLES

    return dict(ORACLES)
