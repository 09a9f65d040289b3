"""All queries of this subpackage and their SQL."""

from veldra.llm import q_contamination, q_dialogue, q_extraction, q_langid, q_nbest, q_neardup, q_passages, q_quality, q_secrets, q_tokenfiles, q_topk, q_toxicity, q_whitening

_MODULES = (q_langid, q_quality, q_neardup, q_contamination, q_dialogue, q_extraction, q_secrets, q_topk, q_tokenfiles, q_passages, q_nbest, q_dialogue, q_whitening, q_toxicity)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
