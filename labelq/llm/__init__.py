"""Operators of a training-data pipeline; ``QUERIES`` and ``ORACLE_SQL`` list their registered queries."""

from labelq.llm import (
    decontaminate,
    embedding_dedup,
    hard_negatives,
    lexical_search,
    licenses,
    mixing,
    ngram_jaccard,
    quality_knn,
    quality_rules,
    sentencepiece_bpe,
    suffix_dedup,
    toxicity_pu,
    warc_fixity,
)

_MODULES = (licenses, toxicity_pu, ngram_jaccard, sentencepiece_bpe, warc_fixity, mixing, suffix_dedup, embedding_dedup, quality_rules, quality_knn,
            hard_negatives, lexical_search, decontaminate)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
