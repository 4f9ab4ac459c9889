"""The registered queries of this subpackage and their SQL."""

from spanloom.llm import bpe, compression, decontaminate, divergence, html, langid, licenses, manifest, quality, secrets, simhash, substrings, tokencounts

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_language": langid.op2_language,
    "op3_bpe": bpe.op3_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_substrings": substrings.op6_substrings,
    "op7_quality": quality.op7_quality,
    "op8_html": html.op8_html,
    "op9_licenses": licenses.op9_licenses,
    "op10_compression": compression.op10_compression,
    "op11_tokens": tokencounts.op11_tokens,
    "op12_manifest": manifest.op12_manifest,
    "op13_divergence": divergence.op13_divergence,
}

#: DuckDB SQL by query, where SQL can state it; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontaminate.ORACLE,
    "op6_substrings": substrings.ORACLE,
    "op9_licenses": licenses.oracle(),
    "op12_manifest": manifest.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
