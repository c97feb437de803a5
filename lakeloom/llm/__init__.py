"""Training-data operators for very large corpora.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin table-level queries built on them.
"""
