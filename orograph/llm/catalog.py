"""Queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from orograph.llm import clusters, decontaminate, language, licenses, packing, resampling, secrets, simhash, substring_dedup, suffix_dedup, toxicity, vptree, warc
from orograph.llm.common import read


def op1_substring(spark, sf_dir):
    return substring_dedup.remove_repeated_passages(read(spark, sf_dir, "documents"), with_text=False)


def op2_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.component_rows(read(spark, sf_dir, "documents"))


def op4_neighbours(spark, sf_dir):
    return vptree.neighbour_rows(read(spark, sf_dir, "embeddings"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.digest_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_warc(spark, sf_dir):
    return warc.derivative_rows(read(spark, sf_dir, "pages"))


def op7_language(spark, sf_dir):
    return language.predict_rows(read(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.scan_rows(read(spark, sf_dir, "documents"))


def op9_suffixes(spark, sf_dir):
    return suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents"), with_text=False)


def op10_toxicity(spark, sf_dir):
    return toxicity.score_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_licenses(spark, sf_dir):
    return licenses.scan_rows(read(spark, sf_dir, "documents"))


def op12_resampling(spark, sf_dir):
    return resampling.sample_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_clusters(spark, sf_dir):
    return clusters.cluster_rows(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring, op2_packing, op3_simhash, op4_neighbours, op5_decontamination, op6_warc, op7_language, op8_secrets, op9_suffixes, op10_toxicity, op11_licenses, op12_resampling, op13_clusters)}
ORACLES = {"op1_substring": substring_dedup.ORACLE, "op9_suffixes": suffix_dedup.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op4_neighbours": vptree.ORACLE, "op6_warc": warc.ORACLE, "op8_secrets": secrets.ORACLE, "op11_licenses": licenses.ORACLE, "op12_resampling": resampling.ORACLE, "op13_clusters": clusters.ORACLE}
