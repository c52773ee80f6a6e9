"""Text predicates and small string functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that Python's str.strip would leave.
_INK = r"(?U)[^\s\x1c-\x1f]"
_BLANK = r"[\s\x1c-\x1f]"


def is_nonblank(text: Column) -> Column:
    """True for text with some non-white character; null and blank are false."""
    return F.coalesce(text.rlike(_INK), F.lit(False))


def stripped(text: Column) -> Column:
    """Without the white space of any script at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def casefolded(text: Column) -> Column:
    """Caseless form: lower case, with the two letters that only full folding maps to ASCII."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))


def cut_at_stops(text: Column, stops: list[str]) -> Column:
    """Cut the text before each stop string in turn; empty stops are refused."""
    if any(not s for s in stops):
        raise ValueError("a stop string must not be empty")
    for s in stops:
        text = F.substring_index(text, s, 1)
    return text


def shown_reply(token_ids: Column, eos_id: int, decoded: Column) -> Column:
    """The decoded reply, or a marker if it is blank and the end token is all there was."""
    only_end = (F.size(token_ids) == 1) & (F.get(token_ids, F.lit(0)) == eos_id)
    return F.when(only_end & ~is_nonblank(decoded), "[EOS]").otherwise(decoded)
