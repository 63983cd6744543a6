"""The registered queries of this subpackage and their SQL."""

from panelscope.llm import alignment, decontamination, exact_search, hmm, packing, quality_cnn, quality_rules, records, sharding, simhash, toxicity, urls, vector_codes

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_simhash": simhash.op2_simhash,
    "op3_language_model": hmm.op3_language_model,
    "op4_url_filter": urls.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_records": records.op6_token_records,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality": quality_cnn.op10_quality,
    "op11_alignment": alignment.op11_alignment,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_exact_search": exact_search.op13_exact_search,
}
#: The others learn, hash, permute or tokenise in ways SQL can't; tests hold them against brute force.
ORACLE_SQL = {"op1_decontamination": decontamination.SQL, "op4_url_filter": urls.SQL, "op12_vector_codes": vector_codes.SQL, "op13_exact_search": exact_search.SQL}
