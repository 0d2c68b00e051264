"""The operators' queries by name, and the SQL that gives the same rows."""

from lexitide.llm import (
    op1_tokens,
    op2_urls,
    op3_packing,
    op4_pii,
    op5_html,
    op6_neardup,
    op7_language,
    op8_decontaminate,
    op9_embeddings,
    op10_quality,
    op11_search,
    op12_negatives,
    op13_warc,
)

QUERIES = {
    "op1_token_counts": op1_tokens.query,
    "op2_url_filter": op2_urls.query,
    "op3_packing": op3_packing.query,
    "op4_pii": op4_pii.query,
    "op5_html_text": op5_html.query,
    "op6_near_duplicates": op6_neardup.query,
    "op7_language": op7_language.query,
    "op8_decontamination": op8_decontaminate.query,
    "op9_embedding_duplicates": op9_embeddings.query,
    "op10_quality": op10_quality.query,
    "op11_lexical_search": op11_search.query,
    "op12_hard_negatives": op12_negatives.query,
    "op13_warc_members": op13_warc.query,
}
ORACLE_SQL: dict = {
    "op11_lexical_search": op11_search.SQL,
    "op12_hard_negatives": op12_negatives.SQL,
    "op13_warc_members": op13_warc.SQL,
}
