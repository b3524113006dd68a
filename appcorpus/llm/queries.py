"""The registered queries of the training-data operators, each over its whole tables."""

from . import chat, decontaminate, fingerprint, infill, language, licenses, mixing, phrases, quality, simhash, substring, toxicity, urls

QUERIES = {
    "op1_licenses": licenses.op1,
    "op2_fingerprint": fingerprint.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_quality": quality.op4,
    "op5_chat": chat.op5,
    "op6_substring_dedup": substring.op6,
    "op7_language": language.op7,
    "op8_mix": mixing.op8,
    "op9_toxicity": toxicity.op9,
    "op10_simhash": simhash.op10,
    "op11_infill": infill.op11,
    "op12_urls": urls.op12,
    "op13_phrases": phrases.op13,
}

ORACLES = {
    "op3_decontaminate": decontaminate.oracle_sql(),
    "op5_chat": chat.oracle_sql(),
    "op6_substring_dedup": substring.oracle_sql(),
    "op11_infill": infill.oracle_sql(),
    "op13_phrases": phrases.oracle_sql(),
}
