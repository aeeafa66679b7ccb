"""Training-data operators: text quality, safety, deduplication, tokenisation and formatting.

Nothing else in the library imports this subpackage; its named queries are in
``queries.py`` and the filtering pipeline over them is ``corpus_pipeline.py``.
"""
