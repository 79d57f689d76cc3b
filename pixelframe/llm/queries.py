"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from . import chat, decontaminate, exact_dedup, html_text, language_model, near_dedup, packing, quality, token_files, toxicity

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_qgram_lemma": decontaminate.op2_qgram_lemma,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_template_removal": html_text.op5_template_removal,
    "op6_orc_tokens": token_files.op6_orc_tokens,
    "op7_log_bilinear": language_model.op7_log_bilinear,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_best_fit": packing.op9_best_fit,
    "op10_quality": quality.op10_quality,
}

ORACLES = {
    "op1_chat_format": chat.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
}
