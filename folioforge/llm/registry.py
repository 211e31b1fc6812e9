"""Queries of this subpackage: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from . import chatformat, decontaminate, fingerprint, importance, language, linedup, neardup, recompress, sentencepiece_wfst, spelling, tokencounts, toxicity, warc

QUERIES = {
    "op1_sentencepiece": (sentencepiece_wfst.op1_sentencepiece, None),
    "op2_fingerprints": (fingerprint.op2_fingerprints, None),
    "op4_toxicity": (toxicity.op4_toxicity, None),
    "op8_neardup": (neardup.op8_neardup, None),
    "op7_decontaminate": (decontaminate.op7_decontaminate, decontaminate.ORACLE_SQL),
    "op10_substrings": (recompress.op10_substrings, recompress.ORACLE_SQL),
    "op3_language": (language.op3_language, None),
    "op9_linedup": (linedup.op9_linedup, linedup.ORACLE_SQL),
    "op6_tokencounts": (tokencounts.op6_tokencounts, None),
    "op11_importance": (importance.op11_importance, importance.ORACLE_SQL),
    "op12_spelling": (spelling.op12_spelling, spelling.ORACLE_SQL),
    "op13_chat": (chatformat.op13_chat, chatformat.ORACLE_SQL),
    "op5_warc": (warc.op5_warc, warc.ORACLE_SQL),
}
