"""The operators' queries and their DuckDB SQL."""

from tidemark.llm import chunks, decontaminate, jaccard, langid, packing, quality, resample, shard, simple8b, suffixes, trie, veccodes, whiten

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_token_files": simple8b.op2_token_files,
    "op3_chunk_dedup": chunks.op3_chunk_dedup,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_sharding": shard.op5_sharding,
    "op6_best_two_fit": packing.op6_best_two_fit,
    "op7_ngram_trie": trie.op7_ngram_trie,
    "op8_substring_removal": suffixes.op8_substring_removal,
    "op9_jaccard_components": jaccard.op9_jaccard_components,
    "op10_importance_resampling": resample.op10_importance_resampling,
    "op11_language_spans": langid.op11_language_spans,
    "op12_spectrum_whitening": whiten.op12_spectrum_whitening,
    "op13_dictionary_codes": veccodes.op13_dictionary_codes,
}
ORACLES = {"op1_quality_rules": quality.OP1_SQL, "op4_benchmark_decontamination": decontaminate.OP4_SQL, "op13_dictionary_codes": veccodes.OP13_SQL}
