"""DataFrame-to-DataFrame operators: merging, evolving, rejecting and reshaping.  They know no storage."""
