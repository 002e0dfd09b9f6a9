from quillon.functions import aggregates, dates, full_text, geo, hashing, json, maths, text  # noqa: F401
from quillon.functions.registry import FUNCTIONS, Function, Scope, build_call, find_function, is_call, register  # noqa: F401
