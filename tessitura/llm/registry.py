"""The queries of this package and, where SQL can express them, their SQL."""

from tessitura.llm import bpe, chat, gif, langid, lm, mixing, quality, simhash, token_counts, topk

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_topk": topk.op3_topk,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_lm": lm.op5_lm,
    "op6_chat": chat.op6_chat,
    "op7_langid": langid.op7_langid,
    "op8_gif": gif.op8_gif,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {"op3_topk": topk.SQL, "op6_chat": chat.SQL, "op10_mixing": mixing.SQL}
