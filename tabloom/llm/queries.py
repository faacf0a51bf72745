"""The queries of the training-data operators, and SQL for those that SQL can express."""

from tabloom.llm import ball_kmeans, chat, collocations, exact_dedup, jaccard, langid, licenses, mixing, pii, repetition, sentencepiece_viterbi, simhash, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_viterbi.op1_sentencepiece,
    "op2_chat": chat.op2_chat,
    "op3_pii": pii.op3_pii,
    "op4_mixing": mixing.op4_mixing,
    "op5_repetition": repetition.op5_repetition,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_langid": langid.op7_langid,
    "op8_licenses": licenses.op8_licenses,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_simhash": simhash.op10_simhash,
    "op11_collocations": collocations.op11_collocations,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_ball_kmeans": ball_kmeans.op13_ball_kmeans,
}

ORACLES = {
    "op2_chat": chat.ORACLE,
    "op3_pii": pii.pii_oracle(),
    "op4_mixing": mixing.mixing_oracle(),
    "op5_repetition": repetition.ORACLE,
    "op8_licenses": licenses.licenses_oracle(),
    "op9_jaccard": jaccard.ORACLE,
    "op11_collocations": collocations.collocations_oracle(),
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_ball_kmeans": ball_kmeans.kmeans_oracle(),
}
