"""Training-data operators: cleaning, de-duplication, scoring and packing of document tables.

Nothing outside this subpackage imports it. Every operator takes a DataFrame of
documents (``doc_id``, ``text`` and any further columns) and returns a DataFrame;
the thin ``opN_*`` queries live in :mod:`tidemark.llm.queries`.
"""
