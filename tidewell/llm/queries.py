"""The queries of this folder, by name: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers

from tidewell.llm import decontaminate, fingerprint, hosts, interactions, licenses, oracles, packing, pii, secrets, simhash, substrings, tokens, toxicity, whitening
from tidewell.llm.common import table


def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark, sf_dir):
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_filter(spark, sf_dir):
    return hosts.judge(table(spark, sf_dir, "pages"), hosts.outcomes_of(table(spark, sf_dir, "labels")))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_secrets": op2_secrets,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_fingerprints": op10_fingerprints,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_url_filter": op12_url_filter,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": oracles.SUBSTRINGS,
    "op6_decontaminate": oracles.DECONTAMINATE,
    "op9_licenses": licenses.oracle(),
    "op11_filter_interactions": oracles.INTERACTIONS,
    "op12_url_filter": oracles.URL_FILTER,
}
