"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage. Its registered queries are in
``queries`` and the corpus pipeline is ``corpus_pipeline.py`` at the repository's top.
"""
