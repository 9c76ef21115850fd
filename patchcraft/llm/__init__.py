"""Training-data operators: quality, deduplication, language, tokens and packing.

Nothing outside this subpackage imports it.  Registered queries are in
``queries.py``; the corpus pipeline is ``corpus_pipeline.py`` at the repository
top.
"""
