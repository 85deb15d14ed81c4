"""Queries of this folder and their SQL, for the entry file."""

from __future__ import annotations

from ..session import read_table
from .bpe import bpe_digests
from .decontam import leaks
from .divergence import source_divergence, source_divergence_sql
from .exact_dedup import exact_dedup, exact_dedup_sql
from .filter_audit import filter_audit, filter_audit_sql
from .langid import language_id
from .licenses import license_scan, license_sql
from .pii import personal_data
from .secrets import secret_scan, secret_sql
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts, trial_edits
from .token_files import token_files


def _on_documents(operator):
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_license_scan": _on_documents(license_scan),
        "op2_exact_dedup": _on_documents(exact_dedup),
        "op3_secret_scan": _on_documents(secret_scan),
        "op4_simhash_components": _on_documents(simhash_components),
        "op5_token_files": _on_documents(token_files),
        "op6_token_counts": _on_documents(lambda docs: token_counts(docs, trial_edits())),
        "op7_language_id": _on_documents(language_id),
        "op8_bpe_encode_decode": _on_documents(bpe_digests),
        "op9_decontamination": lambda spark, sf_dir: leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
        "op10_suffix_dedup": _on_documents(suffix_dedup),
        "op11_personal_data": _on_documents(personal_data),
        "op12_source_divergence": _on_documents(source_divergence),
        "op13_filter_audit": lambda spark, sf_dir: filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_sql(),
        "op2_exact_dedup": exact_dedup_sql(),
        "op3_secret_scan": secret_sql(),
        "op12_source_divergence": source_divergence_sql(),
        "op13_filter_audit": filter_audit_sql(),
    }
