"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from longwatch.llm import chat, digest, embeddings, lines, mixing, passages, phrases, pieces, quality, simhash, suffix, trie, urls

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_water_filling": mixing.op2_water_filling,
    "op3_url_rules": urls.op3_url_rules,
    "op4_simhash_bk_trees": simhash.op4_simhash_bk_trees,
    "op5_nn_descent": embeddings.op5_nn_descent,
    "op6_collinear_chains": passages.op6_collinear_chains,
    "op7_sentencepiece_dropout": pieces.op7_sentencepiece_dropout,
    "op8_suffix_array_dedup": suffix.op8_suffix_array_dedup,
    "op9_canonical_digest": digest.op9_canonical_digest,
    "op10_quality_votes": quality.op10_quality_votes,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_heavy_path_trie": trie.op13_heavy_path_trie,
}
ORACLE = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_water_filling": mixing.OP2_SQL,
    "op11_phrase_collocations": phrases.OP11_SQL,
    "op12_line_dedup": lines.OP12_SQL,
    "op13_heavy_path_trie": trie.OP13_SQL,
}
