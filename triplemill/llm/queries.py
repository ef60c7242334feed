"""Registered queries of this folder: each operator on its whole table, with the
parameters it is meant to be used with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from triplemill.llm import (
    chat,
    decontamination,
    hard_negatives,
    importance,
    licenses,
    line_dedup,
    mixing,
    quality,
    simhash,
    suffix_dedup,
    tokens,
    toxicity,
    url_filter,
)
from triplemill.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query("op1_license_scan")
def _(spark, sf):
    return licenses.scan(read(spark, sf, "documents"))


@query("op2_simhash_near_dedup")
def _(spark, sf):
    return simhash.near_fingerprints(read(spark, sf, "documents"))


@query("op3_url_filter")
def _(spark, sf):
    return url_filter.judged(read(spark, sf, "pages"))


@query("op4_token_counts")
def _(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(read(spark, sf, "documents"), path)


@query("op5_quality_rules")
def _(spark, sf):
    return quality.judged(read(spark, sf, "documents")).drop("distance")


@query("op6_suffix_dedup")
def _(spark, sf):
    return suffix_dedup.digests(read(spark, sf, "documents"))


@query("op7_decontamination")
def _(spark, sf):
    return decontamination.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op8_line_dedup")
def _(spark, sf):
    return line_dedup.digests(read(spark, sf, "documents"))


@query("op9_mixing")
def _(spark, sf):
    return mixing.taken_words(read(spark, sf, "documents"))


@query("op10_chat_formatting", chat.SQL)
def _(spark, sf):
    return chat.collapsed(read(spark, sf, "conversations"))


@query("op11_toxicity")
def _(spark, sf):
    return toxicity.scored(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op12_hard_negatives", hard_negatives.SQL)
def _(spark, sf):
    return hard_negatives.hard_negatives(read(spark, sf, "embeddings"))


@query("op13_importance_resampling", importance.SQL)
def _(spark, sf):
    return importance.resampled(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
