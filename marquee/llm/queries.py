"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from marquee.llm import audio, conversations, embedding_dups, importance, langid, mixing, packing, repeats, simhash, token_counts, token_files, toxicity, warc_fixity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_mixing": mixing.op3_mixing,
    "op4_media_columns": audio.op4_media_columns,
    "op5_embedding_dups": embedding_dups.op5_embedding_dups,
    "op6_warc_fixity": warc_fixity.op6_warc_fixity,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_repeats": repeats.op9_repeats,
    "op10_packing": packing.op10_packing,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_token_files": token_files.op12_token_files,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op6_warc_fixity": warc_fixity.OP6_SQL,
    "op11_importance_resampling": importance.OP11_SQL,
}
