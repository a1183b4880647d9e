"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, exactdedup, licences, media, mixing, neardup, negatives, pieces, quality, secrets, spelling, substrings, tokens

QUERIES = {
    "op1_media_wav": media.op1_media_wav,
    "op2_raked_mixture": mixing.op2_raked_mixture,
    "op3_exact_dedup": exactdedup.op3_exact_dedup,
    "op4_hyperminhash": neardup.op4_hyperminhash,
    "op5_token_files": tokens.op5_token_files,
    "op6_piece_transducer": pieces.op6_piece_transducer,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_licence_scan": licences.op8_licence_scan,
    "op9_rule_ensemble": quality.op9_rule_ensemble,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_suffix_arrays": decontam.op13_suffix_arrays,
}

ORACLE_SQL = {
    "op2_raked_mixture": mixing.SQL,
    "op3_exact_dedup": exactdedup.SQL,
    "op8_licence_scan": licences.SQL,
    "op10_secret_scan": secrets.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_suffix_arrays": decontam.SQL,
}
