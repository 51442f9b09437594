"""Registered queries of the operators, and their SQL where SQL can express them."""

from . import chat, embed_dedup, katz, knn, langid, minhash, mixing, packing, repair, secret_scan, substring, warc, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_topk": knn.op2_topk,
    "op3_chat": chat.op3_chat,
    "op4_substring": substring.op4_substring,
    "op5_warc": warc.op5_warc,
    "op6_katz": katz.op6_katz,
    "op7_embedding_dedup": embed_dedup.op7_embedding_dedup,
    "op8_minhash": minhash.op8_minhash,
    "op9_packing": packing.op9_packing,
    "op10_langid": langid.op10_langid,
    "op11_secrets": secret_scan.op11_secrets,
    "op12_whitening": whitening.op12_whitening,
    "op13_repair": repair.op13_repair,
}
ORACLE = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_topk": knn.ORACLE_SQL,
    "op3_chat": chat.ORACLE_SQL,
    "op4_substring": substring.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op7_embedding_dedup": embed_dedup.ORACLE_SQL,
    "op8_minhash": minhash.ORACLE_SQL,
    "op11_secrets": secret_scan.ORACLE_SQL,
    "op13_repair": repair.ORACLE_SQL,
}
