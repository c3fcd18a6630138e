"""Lexical tokens of SQL text: as an array column, and as a list for texts that are walked in Python."""

from __future__ import annotations

import re
import string
import sys
from functools import cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# One alternative per token shape.  Possessive loops keep long literals off the Java stack.
# Java and Python read the shapes alike, but for the classes of letters and digits.
STRING = r"'(?:[^']++|'')*+'"
QUOTED = r'"(?:[^"]++|"")*+"'
TICKED = r"`(?:[^`]++|``)*+`"
LINE_COMMENT = r"--[^\n]*+"
BLOCK_COMMENT = r"/\*(?s:.*?)\*/"
PART = rf"(?:[\p{{L}}_#@][\p{{L}}\p{{Nd}}_$#@]*+|{QUOTED}|{TICKED})"
NAME = rf"{PART}(?:\.{PART})*+(?:\.\*)?"
NUMBER = r"[0-9]++(?:\.[0-9]++)?"
OPERATOR = r"<>|<=|>=|!=|\|\|"
SPACE = r" \t\n\x0B\f\r"
OTHER = rf"[^{SPACE}]"
TOKEN = "(" + "|".join([STRING, LINE_COMMENT, BLOCK_COMMENT, NAME, NUMBER, OPERATOR, OTHER]) + ")"

# Letters that begin a word or an operand; those beyond ASCII are asked one by one.
_WORD_LETTERS = frozenset(string.ascii_letters + '_#@"`')
_OPERAND_LETTERS = _WORD_LETTERS | frozenset(string.digits + "')")


def sql_tokens(text: Column) -> Column:
    """Tokens in order; quoted tokens stay whole, comments are dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1)
    return F.filter(found, lambda t: ~(t.startswith("--") | t.startswith("/*")))


@cache
def _pattern(ascii_only: bool) -> re.Pattern:
    """White space and a token, for Python; texts of ASCII alone need no class of all letters."""
    spaced = f"[{SPACE}]*+{TOKEN}"
    if ascii_only:
        return re.compile(spaced.replace(r"\p{L}", "A-Za-z").replace(r"\p{Nd}", "0-9"))
    letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    runs = [list(run) for _, run in groupby(enumerate(letters), lambda p: p[1] - p[0])]
    ranges = "".join(f"{chr(run[0][1])}-{chr(run[-1][1])}" for run in runs)
    return re.compile(spaced.replace(r"\p{L}", ranges).replace(r"\p{Nd}", r"\d"))


def tokens_of(text: str) -> list[str]:
    """What ``sql_tokens`` gives, for one text."""
    found = _pattern(text.isascii()).findall(text.rstrip(" \t\n\x0b\f\r"))
    return [t for t in found if t[:2] not in ("--", "/*")] if "--" in text or "/*" in text else found


def begins_word(token: str) -> bool:
    """What ``is_word`` gives, for one token."""
    return token[:1] in _WORD_LETTERS or token[:1].isalpha()


def begins_operand(token: str) -> bool:
    """What ``is_operand`` gives, for one token."""
    return token[:1] in _OPERAND_LETTERS or token[:1].isalpha() or token[:1].isdecimal()


def is_quoted(token: Column) -> Column:
    return token.rlike("^['\"`]")


def is_word(token: Column) -> Column:
    """A name: starts with a letter, an underscore or an identifier quote."""
    return token.rlike(r'^[\p{L}_#@"`]')


def is_operand(token: Column) -> Column:
    return token.rlike(r"^[\p{L}\p{Nd}_#@'\"`)]")
