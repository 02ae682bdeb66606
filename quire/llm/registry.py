"""The subpackage's queries and their SQL."""

from quire.llm import decontamination, html, language_model, neardup, pieces, repeats, sharding, tokenfiles, topk, toxicity

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_text": html.op3_html_text,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_token_files": tokenfiles.op6_token_files,
    "op7_language_model": language_model.op7_language_model,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_repeated_text": repeats.op10_repeated_text,
}
SQL = {"op4_sharding": sharding.OP4_SQL, "op5_exact_topk": topk.OP5_SQL, "op8_decontamination": decontamination.OP8_SQL, "op9_near_duplicates": neardup.OP9_SQL, "op10_repeated_text": repeats.OP10_SQL}
