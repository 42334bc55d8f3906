"""Operators of a training-data pipeline over documents, conversations and vectors.

Each module is one operator with its own DataFrame interface; ``queries`` holds
the thin registered queries and their SQL.  Nothing outside this folder (but
``corpus_pipeline.py`` and the guarded entry point) imports it.
"""
