"""Metric items out of SQL texts: the SELECT items of the main query with the clauses around them.

The spans of a statement (see ``scopes``) say where the main query's branches, items and clauses begin and end, so an
item is a slice of the tokens, whatever brackets it holds.  Queries inside brackets of another clause, and common
table expressions, give no items.  All work stays inside the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from weftline.functions.tokens import begins_operand, begins_word
from weftline.operators import metrics, scopes, sqlcorpus

BRANCH_STEP = 1_000_000  # numbers of branches that every statement of a text has for itself


class Part(NamedTuple):
    """What follows a mark of a branch's own level, up to the next one."""

    clause: str
    tokens: list[str]


def _closed(word: str) -> bool:
    return begins_operand(word) and not scopes.is_reserved(word.upper())


def joined(tokens: list[str]) -> str:
    """Text of tokens with single blanks, none inside brackets, before commas or around a sign or a function's bracket."""
    text = []
    p = q = ""  # the two tokens before
    for w in tokens:
        called = w == "(" and begins_word(p) and not scopes.is_reserved(p.upper())
        sign = p in ("-", "+") and not _closed(q)
        if not (p == "" or w in (")", ",") or p == "(" or called or sign):
            text.append(" ")
        text.append(w)
        p, q = w, p
    return "".join(text)


def _branches(statement: scopes.Scoped) -> Iterator[list[Part]]:
    """Per SELECT of the main query its parts, in order."""
    spans = statement.spans
    for k, (word, _, chain, _, depth, main) in enumerate(spans):
        if word != "SELECT" or not main:
            continue
        own, end = [], statement.size
        for mark, at, around, clause, level, _ in spans[k:]:
            if level < depth or (level == depth and around != chain):
                end = at
                break
            listed = clause == "FROM" and mark in ("FROM", "JOIN", "USING")
            if level == depth and (mark == "," or mark == clause or listed):
                own.append((clause, at + 1))
        ends = [*[at - 1 for _, at in own[1:]], end]
        yield [Part(clause, statement.words[at:to]) for (clause, at), to in zip(own, ends, strict=True)]


def _without_lead(tokens: list[str], *words: str) -> list[str]:
    return tokens[1:] if tokens and tokens[0].upper() in words else tokens


def _clause(branch: list[Part], name: str) -> str | None:
    """Text of a clause of the branch, or nothing without it."""
    parts = [p.tokens for p in branch if p.clause == name]
    return joined([w for tokens in parts for w in tokens]) if parts else None


def _named(tokens: list[str]) -> int:
    """How many tokens at the end of an item name it."""
    last, before = tokens[-1], tokens[-2] if len(tokens) > 1 else ""
    if before.upper() == "AS":
        return 2
    plain = begins_word(last) and not scopes.is_reserved(last.upper())
    return int(plain and (_closed(before) or before.upper() == "END"))


def _items(text: str) -> Iterator[tuple]:
    """The rows of ``metric_items`` of one text."""
    for no, words in enumerate(sqlcorpus.statements(text)):
        if sqlcorpus.kind_of_statement(words) != "SELECT":
            continue
        statement = scopes.scoped(words)
        tables = list(dict.fromkeys(r.name for r in statement.refs if r.role == "read" and not r.hidden))
        for number, branch in enumerate(_branches(statement)):
            group_by = [joined(_without_lead(p.tokens, "BY")) for p in branch if p.clause == "GROUP"]
            where_text, having_text = _clause(branch, "WHERE"), _clause(branch, "HAVING")
            listed = [_without_lead(p.tokens, "DISTINCT", "ALL") for p in branch if p.clause == "SELECT"]
            for place, tokens in enumerate(listed):
                if not tokens:
                    continue
                length = _named(tokens)
                alias, expression = tokens[-1] if length else None, joined(tokens[: len(tokens) - length])
                yield (no * BRANCH_STEP + number + 1, place + 1, alias, expression, group_by, where_text, having_text, tables)


ITEM = (
    "branch_no bigint, item_no int, alias string, expression string, group_by array<string>, where_text string, "
    "having_text string, source_tables array<string>"
)


def metric_items(sql_inputs: DataFrame) -> DataFrame:
    """(sql_id, ord, branch_no, item_no, alias, expression, group_by, where_text, having_text, source_tables) of the main
    queries of all SELECT statements; ``branch_no`` goes up along the branches and statements of a text."""
    return sqlcorpus.by_text(sql_inputs, _items, ITEM, ("sql_id", "ord"))


def metric_statuses(sql_inputs: DataFrame) -> DataFrame:
    """(sql_id, status, metric_count) of SQL texts; one without a statement is PARSE_FAILED."""

    def kinds(text: str) -> list[tuple]:
        return [(sqlcorpus.kind_of_statement(words),) for words in sqlcorpus.statements(text)] or [(None,)]

    found = metrics.probe_metrics(metric_items(sql_inputs))
    return metrics.metric_status(sqlcorpus.by_text(sql_inputs, kinds, "kind string", ("sql_id",)), found)
