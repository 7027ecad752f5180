"""Every query of the library by name, and its SQL where there is one."""

from __future__ import annotations

from foliant.plans import anatomy_queries, benchmark_queries, cipher_queries, corpus_queries, evaluation_queries, general, mechanism_queries, model_queries, review_queries, selection_queries, source_queries, split_queries, stream_queries, summary_queries

FLAGSHIP = "conditional_entropy_1"
_MODULES = (general, corpus_queries, model_queries, split_queries, source_queries, cipher_queries, summary_queries, selection_queries, mechanism_queries, evaluation_queries, review_queries, anatomy_queries, benchmark_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
