"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tapeloom.llm import alignment, decontamination, embedding_dedup, exact_dedup, language_id, lm_scoring, minhash_dedup, mixing, pieces, repeats, secrets, sharding, spelling

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_secrets": secrets.op2,
    "op3_sharding": sharding.op3,
    "op4_minhash_dedup": minhash_dedup.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_language_id": language_id.op6,
    "op7_lm_scoring": lm_scoring.op7,
    "op8_sentencepiece": pieces.op8,
    "op9_repeats": repeats.op9,
    "op10_embedding_dedup": embedding_dedup.op10,
    "op11_alignment": alignment.op11,
    "op12_decontamination": decontamination.op12,
    "op13_spelling": spelling.op13,
}

ORACLES = {
    "op2_secrets": secrets.OP2_SQL,
    "op4_minhash_dedup": minhash_dedup.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op9_repeats": repeats.OP9_SQL,
    "op10_embedding_dedup": embedding_dedup.OP10_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
