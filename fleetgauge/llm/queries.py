"""Registered queries of the dealt operators, each over its whole table."""

from __future__ import annotations

from fleetgauge.llm import cotraining, html_extract, jaccard_join, katz, language_id, merkle, mixing, pieces, quality_rules, secrets_scan, topk_search, warc, word_runs
from fleetgauge.llm.tables import BATCH_ROWS, small_batches, table
from fleetgauge.session import prepare

QUERIES: dict = {}


def query(name: str):
    def add(fn):
        def run(spark, sf):
            prepare(spark)
            small_batches(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        return fn

    return add


@query("op6_quality_rules")
def _(spark, sf):
    return quality_rules.digest(table(spark, sf, "documents"))


@query("op8_ngram_jaccard_join")
def _(spark, sf):
    return jaccard_join.digest(table(spark, sf, "documents"))


@query("op2_mixing")
def _(spark, sf):
    return mixing.digest(table(spark, sf, "documents"))


@query("op10_secret_scans")
def _(spark, sf):
    return secrets_scan.digest(table(spark, sf, "documents"))


@query("op9_sentencepiece")
def _(spark, sf):
    small_batches(spark, 2 * BATCH_ROWS)  # more distinct words share one walk
    return pieces.digest(table(spark, sf, "documents"))


@query("op1_warc")
def _(spark, sf):
    return warc.digest(table(spark, sf, "pages"))


@query("op4_exact_topk")
def _(spark, sf):
    return topk_search.digest(table(spark, sf, "embeddings"))


@query("op3_language_id")
def _(spark, sf):
    return language_id.digest(table(spark, sf, "documents"))


@query("op7_quality_classifier")
def _(spark, sf):
    return cotraining.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_html_extraction")
def _(spark, sf):
    return html_extract.digest(table(spark, sf, "pages"))


@query("op11_merkle_manifest")
def _(spark, sf):
    return merkle.digest(table(spark, sf, "documents"))


@query("op12_word_runs")
def _(spark, sf):
    return word_runs.digest(table(spark, sf, "documents"))


@query("op13_katz_scores")
def _(spark, sf):
    return katz.digest(table(spark, sf, "documents"))
