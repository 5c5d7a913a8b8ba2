"""Text to tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and what they become.
DIACRITICS, PLAIN = "ĄĆĘŁŃÓŚŻŹ", "ACELNOSZZ"
#: What separates words, besides white space.  Other signs are dropped inside a word.
SEPARATORS = ".,;:-!?\"'"
DELIMITERS = r"(?U)[\s" + SEPARATORS.replace("-", r"\-") + "]+"


def taggify(text: Column, max_len: int | None = 3, min_len: int = 1, suffix: bool = False) -> Column:
    """Upper-case beginnings (or ends) of a text's words, each once, in order; words under ``min_len`` are left out."""
    words = F.transform(F.split(text, DELIMITERS), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    words = F.filter(words, lambda w: F.length(w) >= max(1, min_len))
    cut = words if max_len is None else F.transform(words, (lambda w: F.right(w, F.lit(max_len))) if suffix else (lambda w: F.substring(w, 1, max_len)))
    return F.array_distinct(F.transform(cut, lambda w: F.translate(F.upper(w), DIACRITICS, PLAIN)))
