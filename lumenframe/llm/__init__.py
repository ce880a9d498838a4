"""Training-data operators: packing, joins, filters, encoders, archives.

Nothing outside this subpackage imports it; it may be deleted together with
``tests/llm`` and ``corpus_pipeline.py`` and the rest keeps working.
"""
