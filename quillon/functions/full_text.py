"""Full-text search of the 'simple' kind: lower-cased runs of letters and digits, no stemming."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions.registry import Scope, need, register


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def has(document: Column, word: str, prefix: bool = False) -> Column:
    return F.exists(document, lambda t: t.startswith(word)) if prefix else F.array_contains(document, word)


def follows(document: Column, words: list[str]) -> Column:
    """The words stand next to each other in this order."""
    size = len(words)
    places = F.sequence(F.lit(1), F.greatest(F.size(document) - size + 1, F.lit(1)))
    wanted = F.array(*map(F.lit, words))
    return (F.size(document) >= size) & F.exists(places, lambda i: F.slice(document, i, F.lit(size)) == wanted)


TOKEN = re.compile(r"\s*(\(|\)|&|\||!|<->|'[^']*'(?::\*)?|[^\s()&|!<]+)")


def to_tsquery(document: Column, query: str) -> Column:
    """& | ! ( ) <-> and prefixes word:*."""
    parts, at = [], 0
    while at < len(query.rstrip()):
        found = TOKEN.match(query, at)
        if not found:
            raise QueryError(f"syntax error in tsquery: {query!r}")
        parts.append(found[1])
        at = found.end()
    place = 0

    def peek() -> str | None:
        return parts[place] if place < len(parts) else None

    def either() -> Column:
        nonlocal place
        out = both()
        while peek() == "|":
            place += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal place
        out = single()
        while peek() == "&":
            place += 1
            out = out & single()
        return out

    def single() -> Column:
        nonlocal place
        word = peek()
        if word is None or word in ("&", "|", ")", "<->"):
            raise QueryError(f"syntax error in tsquery: {query!r}")
        place += 1
        if word == "!":
            return ~single()
        if word == "(":
            out = either()
            if peek() != ")":
                raise QueryError(f"syntax error in tsquery: {query!r}")
            place += 1
            return out
        prefix = word.endswith(":*")
        plain = words_of(word.removesuffix(":*"))
        while peek() == "<->" and place + 1 < len(parts):
            plain += words_of(parts[place + 1])
            place += 2
        if not plain:
            return F.lit(False)
        return has(document, plain[0], prefix) if len(plain) == 1 else follows(document, plain)

    if not parts:
        return F.lit(False)
    out = either()
    if place != len(parts):
        raise QueryError(f"syntax error in tsquery: {query!r}")
    return out


def plainto_tsquery(document: Column, query: str) -> Column:
    out = F.lit(bool(words_of(query)))
    for word in words_of(query):
        out = out & has(document, word)
    return out


def phraseto_tsquery(document: Column, query: str) -> Column:
    return follows(document, words_of(query)) if words_of(query) else F.lit(False)


def websearch_to_tsquery(document: Column, query: str) -> Column:
    """Words are AND-ed, 'or' is OR, -word is NOT, "quoted words" follow each other."""
    out, pending, either = None, None, False
    for quoted, minus, word in re.findall(r'"([^"]*)"|(-?)([^\s"]+)', query):
        if word.lower() == "or" and not minus:
            either = True
            continue
        plain = words_of(quoted or word)
        if not plain:
            continue
        term = follows(document, plain) if len(plain) > 1 else has(document, plain[0])
        term = ~term if minus else term
        if either and pending is not None:
            pending = pending | term
        else:
            out = pending if out is None else out & pending if pending is not None else out
            pending = term
        either = False
    if pending is None:
        return F.lit(False)
    return pending if out is None else out & pending


QUERIES = {"to_tsquery": to_tsquery, "plainto_tsquery": plainto_tsquery, "phraseto_tsquery": phraseto_tsquery, "websearch_to_tsquery": websearch_to_tsquery}


def match(column: Column, dtype: T.DataType, kind: str, args: list) -> Column:
    """column @@ kind(args). A column of arrays holds tokens already; the last argument is the query."""
    if kind not in QUERIES:
        raise QueryError(f"Unknown text search function {kind}. Expecting one of: {', '.join(QUERIES)}")
    if not args or not isinstance(args[-1], str):
        raise QueryError(f"{kind} expects a query text")
    document = column if isinstance(dtype, T.ArrayType) else tokens(column.cast("string"))
    return QUERIES[kind](document, args[-1])


def headline(scope: Scope, args: list) -> Column:
    """Each word of the query in <b> and </b>."""
    need(args, 2, "$ts_headline")
    query = next(iter(args[1].values())) if isinstance(args[1], dict) else args[1]
    words = words_of(query if isinstance(query, str) else " ".join(map(str, query)))
    text = scope.text(args[0])
    if not words:
        return text
    either = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", "<b>$1</b>")


for _name in ("$ts_headline", "$ts_headline_simple", "$ts_headline_english"):
    register(_name, single=False)(headline)
