"""Brand matching, context windows and keyword sentiment."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlens.lexicon import NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS

# Letters, numbers and the underscore. Spelled out because Java and RE2 each have an own idea of \w.
WORD = r"[\p{L}\p{N}_]"

# Characters that count as blank when a user-entered value is trimmed.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# How far a context reaches to find a sentence end, and how far without one.
SENTENCE_REACH = 100
PLAIN_REACH = 80


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def folded(value: Column) -> Column:
    """The key names and prompt texts are compared on: trimmed and lower-cased."""
    return F.lower(strip(value))


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def whole_word_pattern(name: str) -> str:
    """Regex of a whole-word occurrence of ``name`` (already lower-cased).

    A word boundary is a change between word and other characters, so what has to stand next to the
    name depends on the name's own first and last character. The name comes first and the boundary
    before it is checked by looking back, so the costly test runs on literal hits only.
    """

    def is_word(char: str) -> bool:
        return char.isalnum() or char == "_"

    literal = re.escape(name)
    before = f"(?<!{WORD}{literal})" if is_word(name[0]) else f"(?<={WORD}{literal})"
    after = f"(?!{WORD})" if is_word(name[-1]) else f"(?={WORD})"
    return literal + before + after


def up_to_whole_word(name: str) -> str:
    """Regex of everything up to and including the first whole-word occurrence.

    The length of what it matches, less that of the name, is the index in code points. (The regex
    engine's own offsets count UTF-16 units.)
    """
    return r"(?s)\A.*?" + whole_word_pattern(name)


def extract(text: Column, pattern: Column) -> Column:
    """What a pattern given by a column matches; empty if it does not match."""
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def surroundings(raw: Column, index: Column, width: Column) -> Column:
    """The stretch of text every possible context of a match lies in, cut out once per match."""
    start = F.greatest(index - SENTENCE_REACH, F.lit(0))
    return F.substring(raw, start + 1, index - start + width + SENTENCE_REACH)


def context(stretch: Column, index: Column, width: Column) -> Column:
    """The sentence around a match, from the ``surroundings`` of that match.

    Backwards to just after the last sentence end within reach, forwards to the first one inclusive;
    a fixed number of characters where no sentence ends within reach.
    """
    lead = F.least(index, F.lit(SENTENCE_REACH))
    before = F.substring(stretch, F.lit(1), lead)
    after = F.substring(stretch, lead + width + 1, F.lit(SENTENCE_REACH))
    back = bind(
        F.translate(before, "\n", "."),
        lambda text: F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(
            F.least(index, F.lit(PLAIN_REACH))
        ),
    )
    rest = F.nullif(F.instr(F.translate(after, "\n", "."), "."), F.lit(0))
    forth = F.coalesce(rest, F.lit(PLAIN_REACH))
    return bind(back, lambda behind: F.substring(stretch, lead - behind + 1, behind + width + forth))


def keyword_score(lowered: Column, keywords: Sequence[str], word_match: bool = False) -> Column:
    """How many distinct keywords occur, as substrings or (``word_match``) as whole words."""
    distinct = list(dict.fromkeys(k.lower() for k in keywords))
    if not distinct:
        return F.lit(0)
    if word_match:
        patterns = F.lit([whole_word_pattern(k) for k in distinct])
        return F.size(F.filter(patterns, lambda pattern: F.regexp_like(lowered, pattern)))
    return F.size(F.filter(F.lit(distinct), lambda keyword: F.contains(lowered, keyword)))


def sentiment(
    text: Column,
    positive: Sequence[str] = POSITIVE_KEYWORDS,
    negative: Sequence[str] = NEGATIVE_KEYWORDS,
    word_match: bool = False,
) -> Column:
    def balance(lowered: Column) -> Column:
        return keyword_score(lowered, positive, word_match) - keyword_score(lowered, negative, word_match)

    def label(score: Column) -> Column:
        return F.when(score > 0, "recommended").when(score < 0, "negative").otherwise("neutral")

    return bind(bind(F.lower(text), balance), label)
