"""The 13a tokenizer, the tokenization BLEU is published with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published 13a tokenization, in the order they apply.
LITERALS = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
PATTERNS = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
# The characters Python's str.split() cuts at, but for the plain space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# Ways in which two of . and , can follow each other.
_RUNS = ("..", ".,", ",.", ",,")
# The marks of the first pattern but for the space, which stays one. Named one by one, as the
# pattern library looks such classes up in a table, and ranges one after the other.
_MARKS = r"""!"#$%&()*+/:;<=>?@\[\\\]\^_`{|}~"""
# All marks that are cut off where no two of . and , are neighbours.
_CUT = rf"[{_MARKS}.,\-](?<=[{_MARKS}]|[.,](?=[^0-9])|[^0-9][.,]|[0-9]-)"
# SPACES, with the few that lie above Latin-1 behind one comparison.
_NEAR, _FAR = ("".join(c for c in SPACES if (c > "\xff") == far) for far in (False, True))
_SPACE = f"[{_NEAR}[ -　&&[{_FAR}]]]"


def _split_marks(text: Column) -> Column:
    """The four patterns, for texts where no two of . and , are neighbours.

    Without such neighbours a match never depends on what an earlier match has
    consumed, so each pattern reduces to a character and what stands beside it,
    and all become one that starts with a rare character: one pass over the text.
    """
    return F.regexp_replace(text, _CUT, " $0 ")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it and
    whatever expression it is."""
    return F.get(F.transform(F.array(value), lambda known: use(known)), F.lit(0))


def _restored(text: Column) -> Column:
    plain = text
    for old, new in LITERALS[3:]:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def _cut(text: Column) -> Column:
    spaced = F.regexp_replace(text, f"[{_MARKS}]", " $0 ")
    for pattern, new in PATTERNS[1:]:
        spaced = F.regexp_replace(spaced, pattern, new)
    run = F.lit(False)
    for pair in _RUNS:
        run = run | F.contains(text, F.lit(pair))
    return F.when(run, spaced).otherwise(_split_marks(text))


def _plain_spaces(text: Column) -> Column:
    # In ASCII texts no character asks for the comparison behind the table.
    ascii_only = F.octet_length(text) == F.length(text)
    near = F.regexp_replace(text, f"[{_NEAR}]", " ")
    return F.when(ascii_only, near).otherwise(F.regexp_replace(text, _SPACE, " "))


def tokenize_13a(text: Column) -> Column:
    """array<string> of 13a tokens; NULL stays NULL."""
    for old, new in LITERALS[:3]:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = once(once(text, _restored), _cut)
    # This and a one-character split are several times faster here than a
    # split on a character class with that many members.
    text = once(text, _plain_spaces)
    return F.array_remove(F.split(text, " "), "")
