"""Boolean text search: a query string becomes one Column predicate.

A term is a case-insensitive substring. Precedence, tightest first: terms side by
side, NOT (binary), AND, OR. Terms shorter than ``min_term_len`` match nothing, but
are dropped beside a longer one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'[()]|(?:"[^"]*(?:"|\Z)|[^ \t()"])+')
OPERATORS = ("and", "or", "not")
FIELD = re.compile(r"(?i)(?:message|message_lower):(.*)\Z", re.S)


@dataclass(frozen=True)
class Node:
    """``kind`` is term, near (side by side), and, or, not."""

    kind: str
    text: str = ""
    parts: tuple["Node", ...] = ()


def _term(token: str) -> Node:
    field = FIELD.match(token)
    text = field.group(1) if field else token
    if len(text) >= 2 and text[0] == text[-1] == '"':
        text = text[1:-1]
    return Node("term", text)


class _Reader:
    def __init__(self, query: str):
        self.tokens = TOKEN.findall(query.strip().lower())
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def skip_operators(self, *names: str) -> bool:
        """Runs of operators count once; true if a NOT was among them."""
        negated = False
        while self.peek() in names:
            negated |= self.peek() == "not"
            self.at += 1
        return negated

    def any_of(self) -> Node | None:
        parts = [self.all_of()]
        while self.peek() == "or":
            self.at += 1
            parts.append(self.all_of())
        kept = tuple(p for p in parts if p)
        return Node("or", parts=kept) if len(kept) > 1 else (kept[0] if kept else None)

    def all_of(self) -> Node | None:
        parts = [self.except_of()]
        while self.peek() == "and":
            self.at += 1
            parts.append(self.except_of())
        kept = tuple(p for p in parts if p)
        return Node("and", parts=kept) if len(kept) > 1 else (kept[0] if kept else None)

    def except_of(self) -> Node | None:
        negated = self.skip_operators("and", "or", "not")
        left = self.near()
        if negated and left:
            left = Node("not", parts=(left,))
        while self.peek() == "not":
            self.skip_operators("not", "and", "or")
            right = self.near()
            if right:
                without = Node("not", parts=(right,))
                left = Node("and", parts=(left, without)) if left else without
        return left

    def near(self) -> Node | None:
        parts = []
        while (token := self.peek()) is not None and token not in OPERATORS and token != ")":
            self.at += 1
            if token == "(":
                inner = self.any_of()
                if self.peek() == ")":
                    self.at += 1
                if inner:
                    parts.append(inner)
            else:
                parts.append(_term(token))
        return Node("near", parts=tuple(parts)) if len(parts) > 1 else (parts[0] if parts else None)

    def read(self) -> Node | None:
        parts = []
        while self.peek() is not None:
            if self.peek() == ")":  # nothing is open: skip it
                self.at += 1
                continue
            node = self.any_of()
            if node:
                parts.append(node)
        return Node("near", parts=tuple(parts)) if len(parts) > 1 else (parts[0] if parts else None)


def read_query(query: str | None) -> tuple[bool, Node | None]:
    """(negated, tree). A leading NOT negates the whole rest of the query."""
    reader = _Reader(query or "")
    while reader.peek() in ("and", "or"):
        reader.at += 1
    negated = reader.skip_operators("not")
    return negated, reader.read()


def _short(node: Node, min_len: int) -> bool:
    return node.kind == "term" and len(node.text) < min_len


def _column(node: Node, lowered: Column, min_len: int) -> Column:
    if node.kind == "term":
        return F.lit(False) if _short(node, min_len) else F.contains(lowered, F.lit(node.text))
    if node.kind == "not":
        return ~_column(node.parts[0], lowered, min_len)
    parts = node.parts
    if node.kind == "near":
        parts = [p for p in parts if not _short(p, min_len)] or [parts[0]]
    columns = [_column(p, lowered, min_len) for p in parts]
    out = columns[0]
    for column in columns[1:]:
        out = out | column if node.kind == "or" else out & column
    return out


def query_terms(query: str | None) -> list[str]:
    """The positive terms, for highlighting."""

    def walk(node: Node) -> list[str]:
        if node.kind == "term":
            return [node.text]
        return [] if node.kind == "not" else [t for p in node.parts for t in walk(p)]

    negated, tree = read_query(query)
    return [] if negated or tree is None else walk(tree)


def search_predicate(
    query: str | None, column: Column, min_term_len: int = 3, ignore: str | None = None
) -> Column | None:
    """Rows that match ``query`` and not ``ignore``; None if neither says anything."""
    lowered = F.lower(column)
    negated, tree = read_query(query)
    _, ignored = read_query(ignore)
    unwanted = [t for t in (tree if negated else None, ignored) if t]
    out = None if negated or tree is None else _column(tree, lowered, min_term_len)
    for node in unwanted:
        without = ~_column(node, lowered, min_term_len)
        out = without if out is None else out & without
    return out
