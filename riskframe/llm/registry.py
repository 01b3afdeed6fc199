"""Queries of this subpackage, and their SQL where SQL can express them."""

from riskframe.llm import audit, bpe, codes, jaccard, langid, lm, media, mixing, pii, token_files, topk, toxicity, urls

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_topk": topk.op2_topk,
    "op3_langid": langid.op3_langid,
    "op4_lm": lm.op4_lm,
    "op5_media": media.op5_media,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_urls": urls.op9_urls,
    "op10_pii": pii.op10_pii,
    "op11_audit": audit.op11_audit,
    "op12_codes": codes.op12_codes,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLE_SQL = {
    "op2_topk": topk.SQL_OP2,
    "op6_jaccard": jaccard.SQL_OP6,
    "op8_mixing": mixing.SQL_OP8,
    "op9_urls": urls.SQL_OP9,
    "op11_audit": audit.SQL_OP11,
    "op12_codes": codes.SQL_OP12,
}
