"""Text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions.dates import to_char
from quillon.functions.registry import Scope, need, register
from quillon.plans.fields import parse_fields


def initcap(text: Column) -> Column:
    """A word starts at every alphanumeric character that follows another one."""
    marked = F.regexp_replace(F.lower(text), r"([\p{L}\p{N}]+)", "\u0001$1")
    parts = F.split(marked, "\u0001", -1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


for _name, _make in {"$upper": F.upper, "$lower": F.lower, "$length": F.length, "$reverse": F.reverse, "$trim": F.trim, "$initcap": initcap}.items():

    def _build(scope: Scope, args: list, make=_make, name=_name) -> Column:
        need(args, 1, name)
        return make(scope.text(args[0]))

    register(_name)(_build)


def side(scope: Scope, args: list, name: str) -> tuple[Column, int]:
    need(args, 2, name)
    if isinstance(args[1], bool) or not isinstance(args[1], int):
        raise QueryError(f"{name} expects an integer as second argument")
    return scope.text(args[0]), args[1]


@register("$left", single=False)
def left(scope: Scope, args: list) -> Column:
    text, n = side(scope, args, "$left")
    return F.left(text, F.lit(n)) if n >= 0 else F.left(text, F.greatest(F.length(text) + n, F.lit(0)))


@register("$right", single=False)
def right(scope: Scope, args: list) -> Column:
    text, n = side(scope, args, "$right")
    return F.right(text, F.lit(n)) if n >= 0 else F.right(text, F.greatest(F.length(text) + n, F.lit(0)))


@register("$column")
def column(scope: Scope, args: list) -> Column:
    need(args, 1, "$column")
    return scope.col(args[0])


@register("$unnest_words", kind="rows")
def unnest_words(scope: Scope, args: list) -> Column:
    need(args, 1, "$unnest_words")
    return F.explode(F.split(scope.text(args[0]), " ", -1))


@register("$position", single=False)
def position(scope: Scope, args: list) -> Column:
    need(args, 2, "$position")
    return F.locate(str(args[0]), scope.text(args[1]))


@register("$position_lower", single=False)
def position_lower(scope: Scope, args: list) -> Column:
    need(args, 2, "$position_lower")
    return F.locate(str(args[0]).lower(), F.lower(scope.text(args[1])))


@register("$template_string", single=False)
def template_string(scope: Scope, args: list) -> Column:
    """{name} becomes the column's text, null the empty string; other braces stay."""
    need(args, 1, "$template_string")
    if not isinstance(args[0], str):
        raise QueryError("$template_string expects a string")
    parts = []
    for piece in re.split(r"(\{[^{}]*\})", args[0]):
        name = piece[1:-1]
        if piece.startswith("{") and name in scope.columns:
            parts.append(F.coalesce(scope.text(name), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


@register("$to_char", single=False)
def to_char_function(scope: Scope, args: list) -> Column:
    need(args, 2, "$to_char")
    if isinstance(scope.dtype(args[0]), T.NumericType):
        return F.to_char(scope.col(args[0]).cast("decimal(38,10)") if "." in args[1] else F.round(scope.col(args[0])).cast("decimal(38,0)"), F.lit(args[1]))
    return to_char(scope, args[0], args[1], args[2] if len(args) > 2 else None)


HIGHLIGHT_OPTIONS = {"edgeTruncate", "noFields", "returnType", "matchCase"}


def around(text: Column, term: str, edge: int | None, match_case: bool) -> Column:
    """[before, [match], after] as JSON, or [text] where the term is not in it."""
    place = F.locate(term, text) if match_case else F.locate(term.lower(), F.lower(text))
    before, after = F.substr(text, F.lit(1), place - 1), F.substr(text, place + len(term))
    if edge:
        before, after = F.right(before, F.lit(edge)), F.left(after, F.lit(edge))
    quote = lambda x: F.to_json(F.array(x))
    inner = lambda x: F.substring(quote(x), 2, 1 << 30)
    strip = lambda x: F.left(inner(x), F.length(inner(x)) - 1)
    found = F.concat(F.lit("["), strip(before), F.lit(","), quote(F.substr(text, place, F.lit(len(term)))), F.lit(","), strip(after), F.lit("]"))
    return F.when((place > 0) & F.lit(term != ""), found).otherwise(quote(text))


@register("$term_highlight", filterable=True, single=False)
def term_highlight(scope: Scope, args: list) -> Column:
    need(args, 2, "$term_highlight")
    names, term = parse_fields(args[0], scope.names, allow_empty=False), args[1]
    options = args[2] if len(args) > 2 and args[2] else {}
    if set(options) - HIGHLIGHT_OPTIONS:
        raise QueryError(f"Invalid options for $term_highlight. Expecting: {', '.join(sorted(HIGHLIGHT_OPTIONS))}")
    if not isinstance(term, str):
        raise QueryError(f"Non string term provided: {term!r}")
    kind, match_case, edge = options.get("returnType"), options.get("matchCase", False), options.get("edgeTruncate")
    if kind not in (None, "index", "boolean", "object"):
        raise QueryError("returnType can only be index, boolean or object")
    if edge is not None and (not isinstance(edge, int) or edge < -1):
        raise QueryError("Invalid edgeTruncate. Expecting a positive integer")
    if kind in (None, "index"):
        labels = [F.lit("" if options.get("noFields") else f"{n}: ") for n in names]
        pieces = [F.concat(label, F.coalesce(scope.text(n), F.lit(""))) for label, n in zip(labels, names)]
        text = F.concat_ws(", ", *pieces)
        if kind is None:
            return around(text, term, edge, match_case)
        return (F.locate(term, text) if match_case else F.locate(term.lower(), F.lower(text))) - 1
    usable = [n for n in names if not isinstance(scope.dtype(n), T.BinaryType)]
    if re.search("[a-z]", term, re.I):
        usable = [n for n in usable if not isinstance(scope.dtype(n), T.NumericType)]
        if not usable:
            raise QueryError("Characters can't be found in numeric fields")
    out = None
    for name in usable:
        text = searchable(scope, name)
        hit = text.contains(term) if match_case else F.lower(text).contains(term.lower())
        value = F.lit(True) if kind == "boolean" else F.concat(F.lit(f'{{"{name}":'), around(text, term, edge, match_case), F.lit("}"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    last = F.lit(False) if kind == "boolean" else F.lit(None).cast("string")
    return last if out is None else out.otherwise(last)


def searchable(scope: Scope, name: str) -> Column:
    if isinstance(scope.dtype(name), (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = scope.col(name).cast("timestamp_ntz")
        week = F.ceil(F.dayofyear(at) / 7).cast("string")
        words = F.concat_ws(" ", F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "EEEE MMMM"), F.concat(F.lit("Q"), F.quarter(at).cast("string")), F.concat(F.lit("WK"), F.lpad(week, 2, "0")))
        return F.when(at.isNull(), "").otherwise(words)
    return F.coalesce(scope.text(name), F.lit(""))
