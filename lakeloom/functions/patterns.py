"""Accepted shapes of literals, as Java patterns for the whole value (T4).

``\\z`` and not ``$``: the latter also matches before a final line feed.  Dates
and times are in :mod:`layouts`.
"""

# What counts as a number, an exponent, a boolean.
_THREES = r"-?[0-9]{1,3}(?:[.,]?[0-9]{3})*"
NUMBER = rf"\A{_THREES}\z"
DECIMAL = rf"\A{_THREES}[.,][0-9]+\z"
NUMERIC = rf"\A{_THREES}(?:[.,][0-9]+)?\z"  # one of both
EXPONENT = r"\A-?[0-9]+(?:\.[0-9]+)?[eE][-+]?[0-9]+\z"
LEADING_ZERO = r"\A-?0[0-9]+\z"
BOOLEAN = r"\A(?i:true|false)\z"
BINARY = r"\A[01]+\z"
JSON_START = r"\A\s*[\[{\"]"
