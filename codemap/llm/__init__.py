"""Training-data operators: near-duplicate detection, scoring, extraction, packing and archives.

Nothing outside this subpackage, ``corpus_pipeline.py`` and the driver contract imports it.
"""
