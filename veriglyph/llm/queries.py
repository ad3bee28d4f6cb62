"""The queries of this subpackage and their SQL; each module holds its own."""

from . import (
    chat_format,
    decontamination,
    language_id,
    minhash_dedup,
    permutation_index,
    sentencepiece_codec,
    sharding,
    substring_dedup,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_permutation_index": permutation_index.op4_permutation_index,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_language_id": language_id.op10_language_id,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_minhash_dedup": minhash_dedup.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
}
