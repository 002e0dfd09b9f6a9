"""Filter objects to boolean Columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions import full_text
from quillon.functions.json import canonical, contains_column
from quillon.functions.registry import Scope, build_call, find_function, is_call

COMPARE = {"=": "=", "$eq": "=", "<>": "<>", "$ne": "<>", ">": ">", "$gt": ">", "<": "<", "$lt": "<", ">=": ">=", "$gte": ">=", "<=": "<=", "$lte": "<="}
LIKE = {"$like": (False, False), "$ilike": (True, False), "$nlike": (False, True), "$nilike": (True, True)}
CONTAINS = {"@>": "@>", "$contains": "@>", "<@": "<@", "$containedBy": "<@", "&&": "&&", "$overlaps": "&&"}
OTHER = ("$in", "$nin", "$between", "$notBetween", "$isDistinctFrom", "$isNotDistinctFrom", "@@")
OPERATORS = {*COMPARE, *LIKE, *CONTAINS, *OTHER}
EXISTS = ("$exists", "$notExists", "$existsJoined", "$notExistsJoined")
INTERVAL_UNITS = ("years", "months", "days", "hours", "minutes", "seconds")


@dataclass
class FilterScope:
    """What filter keys may name. aliases come before columns, as in a select's result."""

    scope: Scope
    filterable: list[str] | None = None
    aliases: dict[str, tuple[Column, T.DataType | None]] = field(default_factory=dict)
    aggregates: set[str] = field(default_factory=set)
    exists: Callable[[str, dict], Column] | None = None
    call: Callable[[dict], Column] | None = None  # builds functions; having adds aggregates
    computed: bool = True

    def column(self, name: str) -> tuple[Column, T.DataType | None]:
        if name in self.aliases:
            return self.aliases[name]
        if name in self.aggregates:
            raise QueryError(f"{name} is an aggregate: use having instead of the filter")
        if name not in self.scope.columns or (self.filterable is not None and name not in self.filterable):
            raise QueryError(f"{name} is invalid/disallowed for filtering. Allowed columns: {', '.join(self.filterable or self.scope.names)}")
        return self.scope.col(name), self.scope.columns[name]


def literal(value: object, dtype: T.DataType | None) -> Column:
    """A literal of the column's type, so that the comparison can reach the scan."""
    if isinstance(value, dict) and set(value) <= set(INTERVAL_UNITS) and value:
        return interval(value)
    if isinstance(value, (list, tuple)):
        element = dtype.elementType if isinstance(dtype, T.ArrayType) else None
        made = F.array(*[literal(v, element) for v in value])
        return made.cast(dtype) if isinstance(dtype, T.ArrayType) else made
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)) and isinstance(value, str):
        return when(value).cast(dtype)
    out = F.lit(value)
    if dtype is None or isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return out
    if isinstance(dtype, T.StringType) and not isinstance(value, str):
        return F.lit(json.dumps(value) if isinstance(value, bool) else str(value))
    if isinstance(dtype, T.IntegralType) and isinstance(value, float) and value != int(value):
        return out
    if isinstance(dtype, T.IntegralType) and isinstance(value, int):
        return out  # widened by the analyser where the value needs it
    return out.cast(dtype)


def when(value: str) -> Column:
    """ISO texts, and the form 04 Dec 1996 00:12:00."""
    from datetime import datetime

    for pattern in ("%d %b %Y %H:%M:%S", "%d %b %Y"):
        try:
            return F.lit(datetime.strptime(value, pattern).isoformat(" ")).cast("timestamp_ntz")
        except ValueError:
            pass
    return F.lit(value).cast("timestamp_ntz")


def interval(value: dict) -> Column:
    if set(value) <= {"years", "months"}:
        return F.make_ym_interval(F.lit(value.get("years", 0)), F.lit(value.get("months", 0)))
    if set(value) & {"years", "months"}:
        raise QueryError("An interval can't mix months with days and less")
    return F.make_dt_interval(*[F.lit(value.get(u, 0)) for u in ("days", "hours", "minutes")], F.lit(float(value.get("seconds", 0))).cast("decimal(18,6)"))


def compare(op: str, column: Column, value: object, dtype: T.DataType | None) -> Column:
    """column op value for every operator of the grammar. value may be a Column."""
    if op in COMPARE:
        sign = COMPARE[op]
        if value is None:
            if sign == "=":
                return column.isNull()
            if sign == "<>":
                return column.isNotNull()
        right = value if isinstance(value, Column) else literal(value, dtype)
        return {"=": column.__eq__, "<>": column.__ne__, ">": column.__gt__, "<": column.__lt__, ">=": column.__ge__, "<=": column.__le__}[sign](right)
    if op in ("$in", "$nin"):
        if value is not None and not isinstance(value, (list, tuple)):
            raise QueryError(f"{op} expects an array, got {value!r}")
        known = [v for v in value or [] if v is not None]
        null = value is not None and len(known) < len(value)
        if op == "$in":
            out = column.isin(*[literal(v, dtype) for v in known]) if known else F.lit(False)
            return out | column.isNull() if null else out
        out = ~column.isin(*[literal(v, dtype) for v in known]) if known else F.lit(True)
        return out & column.isNotNull() if null else out
    if op in ("$between", "$notBetween"):
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise QueryError(f"{op} expects an array of two values")
        out = column.between(literal(value[0], dtype), literal(value[1], dtype))
        return ~out if op == "$notBetween" else out
    if op in LIKE:
        fold, negate = LIKE[op]
        text = column.cast("string")
        out = text.ilike(str(value)) if fold else text.like(str(value))
        return ~out if negate else out
    if op in ("$isDistinctFrom", "$isNotDistinctFrom"):
        right = value if isinstance(value, Column) else literal(value, dtype) if value is not None else F.lit(None)
        out = column.eqNullSafe(right)
        return ~out if op == "$isDistinctFrom" else out
    if op in CONTAINS:
        return contained(CONTAINS[op], column, value, dtype)
    if op == "@@":
        if not isinstance(value, dict) or len(value) != 1:
            raise QueryError('@@ expects {"to_tsquery": ["query"]}')
        kind, args = next(iter(value.items()))
        return full_text.match(column, dtype or T.StringType(), kind, [args] if isinstance(args, str) else args)
    raise QueryError(f"Unrecognised filter operand: {op}. Expecting one of: {', '.join(sorted(OPERATORS))}")


def contained(op: str, column: Column, value: object, dtype: T.DataType | None) -> Column:
    if isinstance(dtype, T.ArrayType):
        if not isinstance(value, (list, tuple)):
            raise QueryError(f"{op} on an array column expects an array")
        right = literal(value, dtype)
        if op == "&&":
            return F.arrays_overlap(column, right) if value else F.lit(False)
        if op == "@>":
            return F.size(F.array_except(right, column)) == 0
        return F.size(F.array_except(column, right)) == 0
    if op == "&&" and isinstance(dtype, T.StructType):
        return envelope(column, value)
    if op == "&&":
        raise QueryError("&& needs an array or point column")
    return contains_column(column.cast("string"), value, reverse=op == "<@")


def envelope(column: Column, value: object) -> Column:
    """Within {"st_makeenvelope": [xmin, ymin, xmax, ymax, srid?]}."""
    args = value.get("st_makeenvelope", value.get("ST_MakeEnvelope")) if isinstance(value, dict) else None
    if not isinstance(args, (list, tuple)) or len(args) not in (4, 5):
        raise QueryError('&& on points expects {"st_makeenvelope": [xmin, ymin, xmax, ymax]}')
    x1, y1, x2, y2 = map(float, args[:4])
    return column["lng"].between(min(x1, x2), max(x1, x2)) & column["lat"].between(min(y1, y2), max(y1, y2))


JSON_STEP = re.compile(r"(->>|->)")


def json_path(filters: FilterScope, key: str) -> tuple[Column, T.DataType] | None:
    """The text at "col->a->>b", for a column that may be filtered."""
    parts = JSON_STEP.split(key)
    if len(parts) < 3:
        return None
    column, _ = filters.column(parts[0].strip())
    steps = "".join(f"[{p}]" if re.fullmatch(r"\d+", p) else f"['{p}']" for p in (x.strip().strip("'") for x in parts[2::2]))
    return F.get_json_object(column.cast("string"), f"${steps}"), T.StringType()


def split_key(filters: FilterScope, key: str) -> tuple[str, list[str]]:
    """"col.op.rest" to the column and the operators after it; names with dots of their own come first."""
    known = [*filters.aliases, *filters.scope.columns]
    if key in known or key.startswith("$"):
        return key, []
    for at in sorted((m.start() for m in re.finditer(r"\.", key)), reverse=True):
        head, tail = key[:at], key[at + 1 :]
        first = tail.split(".", 1)
        if (head in known or "->" in head) and first[0] in OPERATORS:
            return head, [first[0], *first[1:]]
    return key, []


def item(filters: FilterScope, key: str, value: object) -> Column:
    name, operators = split_key(filters, key)
    for op in reversed(operators):
        value = {op: value}
    found = json_path(filters, name) if "->" in name and name not in filters.scope.columns else None
    if found is None and filters.computed and name == "$rowhash":
        found = find_function("$rowhash").build(filters.scope, []), T.StringType()
    column, dtype = found or filters.column(name)
    if isinstance(value, dict) and value:
        ops = [k for k in value if k in OPERATORS]
        if len(ops) == len(value):
            out = None
            for op, right in value.items():
                test = compare(op, column, right, dtype)
                out = test if out is None else out & test
            return out
        if set(value) <= set(INTERVAL_UNITS) and isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return column == interval(value)
        if isinstance(dtype, T.StructType) and "&&" not in value and len(value) == 1 and "st_makeenvelope" in value:
            return envelope(column, value)
        if isinstance(dtype, (T.StringType, T.VariantType)) and not any(k.startswith(("$", "@", "<", ">", "=")) for k in value):
            return canonical(column.cast("string")) == canonical(F.lit(json.dumps(value)))
        raise QueryError(f"Unrecognised filter operand(s): {', '.join(k for k in value if k not in OPERATORS)}")
    if isinstance(value, (list, tuple)) and isinstance(dtype, T.StringType):
        return canonical(column) == canonical(F.lit(json.dumps(value)))
    return compare("=", column, value, dtype)


def complex_filter(filters: FilterScope, spec: object) -> Column:
    """[{"$fn": [...]}, op, value or {"$fn": [...]}], or [{"$fn": [...]}] alone."""
    if not isinstance(spec, (list, tuple)) or len(spec) not in (1, 3):
        raise QueryError(f"Invalid $filter. Expecting [function] or [function, comparator, value], got {spec!r}")

    def side(value: object) -> Column:
        if isinstance(value, dict) and "$column" in value and isinstance(value["$column"], str):
            return filters.column(value["$column"])[0]
        if not is_call(value):
            raise QueryError(f"Invalid $filter. Expecting a function, got {value!r}")
        return filters.call(value) if filters.call else build_call(filters.scope, value)[1]

    left = side(spec[0])
    if len(spec) == 1:
        return left
    op, right = spec[1], spec[2]
    if op not in OPERATORS:
        raise QueryError(f"Invalid $filter. comparator {op!r} is not valid. Expecting one of: {', '.join(sorted(OPERATORS))}")
    return compare(op, left, side(right) if isinstance(right, dict) and is_call(right) else right, None)


def compile_filter(filters: FilterScope, wanted: object) -> Column | None:
    """The condition of a filter object; None where there is none. An empty $or matches everything."""
    if wanted is None:
        return None
    if not isinstance(wanted, dict):
        raise QueryError(f"Invalid filter: expecting an object, got {wanted!r}")
    out = None
    for key, value in wanted.items():
        if key in ("$and", "$or"):
            if len(wanted) > 1:
                raise QueryError(f"{key} must be the only key of its object")
            if not isinstance(value, (list, tuple)):
                raise QueryError(f"{key} expects an array")
            parts = [c for c in (compile_filter(filters, v) for v in value) if c is not None]
            group = None
            for part in parts:
                group = part if group is None else group & part if key == "$and" else group | part
            return group
        if key == "$filter":
            test = complex_filter(filters, value)
        elif key in EXISTS and isinstance(value, dict) and value:
            if filters.exists is None:
                raise QueryError("Nested exists filters are not supported")
            test = filters.exists(key, value)
        elif key.startswith("$") and key != "$rowhash" and key not in filters.aliases:
            function = find_function(key)
            if not function.filterable:
                raise QueryError(f"{key} can't be used as a filter")
            test = function.build(filters.scope, list(value))
        else:
            test = item(filters, key, value)
        out = test if out is None else out & test
    return out
