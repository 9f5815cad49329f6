"""Queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    decontamination,
    exact_dedup,
    html_extract,
    language_id,
    mixing,
    packing,
    phrases,
    prefix_trie,
    secret_scan,
    sharding,
    simhash,
    token_counts,
    weighted_fingerprint,
)
from .common import read_table


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op4_weighted_fingerprint(spark, sf_dir):
    return weighted_fingerprint.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return language_id.identify_languages(read_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.grafted_trie(read_table(spark, sf_dir, "conversations"))


def op12_phrase_mining(spark, sf_dir):
    return phrases.top_phrases(read_table(spark, sf_dir, "documents"))


def op13_decontamination(spark, sf_dir):
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_ALL = [
    op1_best_fit_packing,
    op2_source_mixing,
    op3_html_extraction,
    op4_weighted_fingerprint,
    op5_language_id,
    op6_exact_dedup,
    op7_token_counts,
    op8_sharding,
    op9_secret_scan,
    op10_simhash,
    op11_prefix_trie,
    op12_phrase_mining,
    op13_decontamination,
]


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    return {
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_sharding": sharding.ORACLE_SQL,
        "op9_secret_scan": secret_scan.ORACLE_SQL,
        "op11_prefix_trie": prefix_trie.ORACLE_SQL,
        "op12_phrase_mining": phrases.ORACLE_SQL,
        "op13_decontamination": decontamination.ORACLE_SQL,
    }
