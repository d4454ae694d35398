"""Training-data operators: ten components that work on whole corpora.

Nothing outside this subpackage imports it. The queries that apply the
operators to the benchmark tables are in :mod:`geoloom.llm.queries`.
"""
