"""The queries of this subpackage and, where SQL can express them, their SQL."""

from plumery.llm import decontam, exact_dedup, langid, lexical, line_dedup, merkle, neighbours, pii, quality, sentencepieces, sharding, simhash, token_store

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_token_store": token_store.op3_token_store,
    "op4_sharding": sharding.op4_sharding,
    "op5_simhash": simhash.op5_simhash,
    "op6_sentencepiece": sentencepieces.op6_sentencepiece,
    "op7_pii": pii.op7_pii,
    "pii_counts": pii.pii_counts,
    "op8_langid": langid.op8_langid,
    "op9_quality": quality.op9_quality,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_lexical": lexical.op11_lexical,
    "op12_merkle": merkle.op12_merkle,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}
ORACLES = {**line_dedup.SQL, **neighbours.SQL, **sharding.SQL, **decontam.SQL, **pii.SQL, **lexical.SQL, **merkle.SQL, **exact_dedup.SQL}
