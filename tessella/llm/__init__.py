"""Training-data operators: selection, cleaning and arrangement of large text corpora.

Nothing outside this subpackage imports it.
"""
