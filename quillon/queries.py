"""The engine's registered queries, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.plans.access import DeleteRule, SelectRule, TableRules, UpdateRule, narrowed
from quillon.sources.catalog import star_catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    return Engine(spark, star_catalog(spark, sf_dir, tables))


def query(name: str, sql: str | None, *tables: str):
    """Register f(engine) -> DataFrame over tables."""

    def add(f: Callable[[Engine], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(engine(spark, sf_dir, *tables))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def find(name: str, table: str, wanted: dict, params: dict, sql: str, *others: str) -> None:
    """Register a plain find; limit is none unless params say otherwise."""
    query(name, sql, table, *others)(lambda e: e.find(table, wanted, {"limit": None, **params}))


def joined(array: Column, field: str) -> Column:
    """The field's values of an array of structs, in order, joined by commas."""
    return F.array_join(F.transform(array, lambda x: x[field].cast("string")), ",")


# -- projection -----------------------------------------------------------------------------------

CUST = {"select": {"c_custkey": 1}}
find("find_select_list", "customer", {}, {"select": ["c_custkey", "c_name"]}, "SELECT c_custkey, c_name FROM customer")
find("find_select_text", "customer", {}, {"select": "c_custkey, c_name"}, "SELECT c_custkey, c_name FROM customer")
find("find_star", "nation", {}, {}, "SELECT * FROM nation")
find("find_exclude_fields", "customer", {}, {"select": {"c_name": 0, "c_acctbal": 0}}, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
find("find_star_plus", "nation", {}, {"select": {"*": 1, "up": {"$upper": ["n_name"]}}}, "SELECT *, upper(n_name) AS up FROM nation")
find("find_alias_column", "nation", {}, {"select": {"label": {"$column": ["n_name"]}}}, "SELECT n_name AS label FROM nation")
find("find_shorthand_function", "region", {}, {"select": {"r_name": "$lower"}}, "SELECT lower(r_name) AS r_name FROM region")
find("find_one_tiebreak", "customer", {}, {"select": ["c_custkey"], "orderBy": [{"c_acctbal": -1}, {"c_custkey": 1}], "limit": 1}, "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
query("count_basic", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'", "orders")(lambda e: e.counted("orders", {"o_orderstatus": "F"}))
query("count_groups", "SELECT count(*) AS count FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)", "orders")(lambda e: e.counted("orders", {}, {"select": {"o_orderstatus": 1, "o_orderpriority": 1, "n": {"$countAll": []}}}))

# -- filters --------------------------------------------------------------------------------------


def keys_where(name: str, table: str, key: str, wanted: dict, where: str) -> None:
    find(name, table, wanted, {"select": [key]}, f"SELECT {key} FROM {table} WHERE {where}")


keys_where("f_eq", "customer", "c_custkey", {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'")
keys_where("f_ne", "customer", "c_custkey", {"c_mktsegment": {"$ne": "BUILDING"}}, "c_mktsegment <> 'BUILDING'")
keys_where("f_range_ops", "orders", "o_orderkey", {"o_totalprice": {"$gt": 100000, "<=": 250000.5}, "o_orderdate": {"$gte": "1996-01-01", "$lt": "1998-06-01"}}, "o_totalprice > 100000 AND o_totalprice <= 250000.5 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-06-01'")
keys_where("f_in", "customer", "c_custkey", {"c_nationkey": {"$in": [1, 3, 5]}}, "c_nationkey IN (1, 3, 5)")
keys_where("f_in_null", "customer", "c_custkey", {"c_nationkey": {"$in": [1, None]}}, "c_nationkey = 1 OR c_nationkey IS NULL")
keys_where("f_in_empty", "customer", "c_custkey", {"c_nationkey": {"$in": []}}, "false")
keys_where("f_nin", "customer", "c_custkey", {"c_nationkey": {"$nin": [1, 3, None]}}, "c_nationkey NOT IN (1, 3) AND c_nationkey IS NOT NULL")
keys_where("f_between", "part", "p_partkey", {"p_size": {"$between": [10, 20]}}, "p_size BETWEEN 10 AND 20")
keys_where("f_not_between", "part", "p_partkey", {"p_size": {"$notBetween": [10, 20]}}, "p_size NOT BETWEEN 10 AND 20")
keys_where("f_like", "part", "p_partkey", {"p_name": {"$like": "red%"}}, "p_name LIKE 'red%'")
keys_where("f_ilike", "part", "p_partkey", {"p_name": {"$ilike": "%WIDGET"}}, "p_name ILIKE '%WIDGET'")
keys_where("f_not_like", "part", "p_partkey", {"p_name": {"$nlike": "red%"}, "p_brand": {"$nilike": "brand#1%"}}, "p_name NOT LIKE 'red%' AND p_brand NOT ILIKE 'brand#1%'")
keys_where("f_like_number", "customer", "c_custkey", {"c_custkey": {"$like": "1%"}}, "CAST(c_custkey AS VARCHAR) LIKE '1%'")
keys_where("f_distinct_from", "customer", "c_custkey", {"c_nationkey": {"$isDistinctFrom": 3}, "c_mktsegment": {"$isNotDistinctFrom": "BUILDING"}}, "c_nationkey IS DISTINCT FROM 3 AND c_mktsegment IS NOT DISTINCT FROM 'BUILDING'")
keys_where("f_null", "customer", "c_custkey", {"$and": [{"c_nationkey": {"<>": None}}, {"c_acctbal": {"<": 0}}]}, "c_nationkey IS NOT NULL AND c_acctbal < 0")
keys_where("f_and_or_nested", "orders", "o_orderkey", {"$or": [{"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {">": 400000}}]}, {"o_orderpriority": "1-URGENT", "o_orderstatus": "O"}]}, "(o_orderstatus = 'F' AND o_totalprice > 400000) OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')")
keys_where("f_empty_or", "nation", "n_nationkey", {"$or": []}, "true")
keys_where("f_json_path", "events", "event_id", {"props->>k": "42"}, "CAST(json_extract_string(props, '$.k') AS VARCHAR) = '42'")
keys_where("f_json_document", "events", "event_id", {"props": {"k": 7}}, "CAST(json_extract(props, '$.k') AS INTEGER) = 7")
keys_where("f_json_contains", "events", "event_id", {"props": {"@>": {"k": 7}}}, "CAST(json_extract(props, '$.k') AS INTEGER) = 7")
keys_where("f_dot_shorthand", "part", "p_partkey", {"p_size.>=": 45, "p_name.$ilike": "%ring%"}, "p_size >= 45 AND p_name ILIKE '%ring%'")


def with_words(e: Engine) -> Engine:
    table = e.catalog.table("part")
    e.catalog.add("part_words", table.df.select("p_partkey", F.split("p_name", " ").alias("words")), ["p_partkey"])
    return e


WORDS = "(SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)"
query("f_array_contains", f"SELECT p_partkey FROM {WORDS} WHERE list_has_all(words, ['red', 'widget'])", "part")(lambda e: with_words(e).find("part_words", {"words": {"@>": ["red", "widget"]}}, {"select": ["p_partkey"], "limit": None}))
query("f_array_contained", f"SELECT p_partkey FROM {WORDS} WHERE list_has_all(['red', 'widget', 'small'], words)", "part")(lambda e: with_words(e).find("part_words", {"words": {"$containedBy": ["red", "widget", "small"]}}, {"select": ["p_partkey"], "limit": None}))
query("f_array_overlaps", f"SELECT p_partkey FROM {WORDS} WHERE list_has_any(words, ['blue', 'ring'])", "part")(lambda e: with_words(e).find("part_words", {"words": {"&&": ["blue", "ring"]}}, {"select": ["p_partkey"], "limit": None}))
keys_where("complex_filter_funcs", "orders", "o_orderkey", {"$and": [{"$filter": [{"$year": ["o_orderdate"]}, "=", "1996"]}, {"$filter": [{"$Mon": ["o_orderdate"]}, "$in", ["Dec", "Jan"]]}]}, "year(o_orderdate) = 1996 AND month(o_orderdate) IN (12, 1)")
keys_where("complex_filter_columns", "customer", "c_custkey", {"$filter": [{"$upper": ["c_mktsegment"]}, "=", {"$column": "c_mktsegment"}]}, "upper(c_mktsegment) = c_mktsegment")
find("filter_by_alias", "nation", {"up": "NATION_3"}, {"select": {"up": {"$upper": ["n_name"]}, "n_nationkey": 1}}, "SELECT upper(n_name) AS up, n_nationkey FROM nation WHERE upper(n_name) = 'NATION_3'")

# -- sort, limit ----------------------------------------------------------------------------------

def placed(df: DataFrame) -> DataFrame:
    """With the place of each row in the order of df, so that a check sees the order of the whole table.

    Partitions of a sorted result follow each other: a row's place is its place in its partition and the
    rows of the partitions before, whose counts alone come to the driver. Kept, so that both reads see
    the same partitions.
    """
    numbered = df.withColumn("at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("at", 33)
    counts = {r.part: r.n for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = list(accumulate((counts[p] for p in sorted(counts)), initial=0))
    starts = df.sparkSession.createDataFrame(list(zip(sorted(counts), before)), "part long, before long")
    out = numbered.join(F.broadcast(starts), part == F.col("part"))
    return out.select(*df.columns, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


def sorted_whole(name: str, table: str, params: dict, source: str, order: str, extend=lambda e: e, base: str | None = None) -> None:
    key = params["select"][0]
    query(name, f"SELECT {key}, row_number() OVER (ORDER BY {order}) AS place FROM {source}", base or table)(lambda e: placed(extend(e).find(table, {}, {**params, "limit": None})))


sorted_whole("sort_multi", "customer", {"select": ["c_custkey"], "orderBy": [{"c_mktsegment": 1}, {"c_acctbal": -1}, {"c_custkey": True}]}, "customer", "c_mktsegment, c_acctbal DESC, c_custkey")
sorted_whole("sort_hidden_column", "part", {"select": ["p_partkey"], "orderBy": {"p_retailprice": "desc", "p_partkey": "asc"}}, "part", "p_retailprice DESC, p_partkey")
find("topk_offset", "orders", {}, {"select": ["o_orderkey", "o_totalprice"], "orderBy": [{"o_totalprice": -1}, {"o_orderkey": 1}], "limit": 20, "offset": 15}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15")
query("limit_default", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000", "orders")(lambda e: e.find("orders", {}, {"select": ["o_orderkey"], "orderBy": "o_orderkey"}))


def with_nulls(e: Engine) -> Engine:
    df = e.catalog.table("customer").df.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"))
    e.catalog.add("customer_nulls", df, ["c_custkey"])
    return e


NULLS = "(SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS seg FROM customer)"
sorted_whole("sort_nulls_first", "customer_nulls", {"select": ["c_custkey"], "orderBy": [{"key": "bal", "asc": True, "nulls": "first"}, {"c_custkey": 1}]}, NULLS, "bal NULLS FIRST, c_custkey", with_nulls, "customer")
sorted_whole("sort_nulls_default", "customer_nulls", {"select": ["c_custkey"], "orderBy": [{"bal": -1}, {"c_custkey": 1}]}, NULLS, "bal DESC NULLS FIRST, c_custkey", with_nulls, "customer")
sorted_whole("sort_null_empty", "customer_nulls", {"select": ["c_custkey"], "orderBy": [{"key": "seg", "asc": False, "nulls": "last", "nullEmpty": True}, {"c_custkey": 1}]}, NULLS, "nullif(trim(seg), '') DESC NULLS LAST, c_custkey", with_nulls, "customer")
query("agg_array_agg_nulls", f"SELECT seg, len(list(bal)) AS n, count(bal) AS known FROM {NULLS} GROUP BY seg", "customer")(lambda e: with_nulls(e).find("customer_nulls", {}, {"select": {"seg": 1, "all": {"$array_agg": ["bal"]}, "known": {"$count": ["bal"]}}}).select("seg", F.size("all").cast("long").alias("n"), "known"))

# -- aggregates -----------------------------------------------------------------------------------

find("agg_global", "lineitem", {}, {"select": {"n": {"$countAll": []}, "qty": {"$sum": ["l_quantity"]}}}, "SELECT count(*) AS n, sum(l_quantity) AS qty FROM lineitem")
find("agg_implicit_group", "orders", {}, {"select": {"o_orderstatus": 1, "o_orderpriority": 1, "n": {"$countAll": []}}}, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
find("agg_by_function", "orders", {}, {"select": {"y": {"$year": ["o_orderdate"]}, "n": {"$countAll": []}}}, "SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders GROUP BY ALL")
find("group_distinct", "lineitem", {}, {"select": ["l_returnflag", "l_linestatus"], "groupBy": True}, "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
find("agg_sum_avg_min_max", "lineitem", {}, {"select": {"l_returnflag": 1, "s": {"$sum": ["l_quantity"]}, "a": {"$avg": ["l_quantity"]}, "lo": {"$min": ["l_shipdate"]}, "hi": {"$max": ["l_extendedprice"]}}}, "SELECT l_returnflag, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
find("agg_string_agg", "nation", {}, {"select": {"n_regionkey": 1, "names": {"$string_agg": ["n_name", ";"]}}}, "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
query("agg_array_agg", "SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS ids FROM nation GROUP BY 1", "nation")(lambda e: e.find("nation", {}, {"select": {"n_regionkey": 1, "ids": {"$array_agg": ["n_nationkey"]}}}).select("n_regionkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")))
find("agg_json_agg", "nation", {}, {"select": {"n_regionkey": 1, "ids": {"$json_agg": ["n_nationkey"]}}}, "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS ids FROM nation GROUP BY 1")
find("agg_diff_perc", "part", {}, {"select": {"p_brand": 1, "d": {"$diff_perc": ["p_retailprice"]}}}, "SELECT p_brand, round((max(p_retailprice) - min(p_retailprice)) / nullif(min(p_retailprice), 0) * 100, 2) AS d FROM part GROUP BY 1")
find("agg_md5_multi", "nation", {}, {"select": {"n_regionkey": 1, "h": {"$md5_multi_agg": ["n_name"]}, "s": {"$sha256_multi_agg": ["n_name"]}}}, "SELECT n_regionkey, md5(string_agg(n_name, ',' ORDER BY n_name)) AS h, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS s FROM nation GROUP BY 1")
find("having_alias", "orders", {}, {"select": {"o_custkey": 1, "n": {"$countAll": []}}, "having": {"n": {">=": 15}}}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
find("having_filter_func", "orders", {}, {"select": {"o_custkey": 1, "n": {"$countAll": []}}, "having": {"$filter": [{"$sum": ["o_totalprice"]}, ">", 3000000]}}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000")
find("sort_by_aggregate", "orders", {}, {"select": {"o_custkey": 1, "n": {"$countAll": []}}, "orderBy": [{"n": -1}, {"o_custkey": 1}], "limit": 10}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")

# -- text, hash, maths ----------------------------------------------------------------------------

find("fn_text", "part", {}, {"select": {"p_partkey": 1, "u": {"$upper": ["p_name"]}, "l": {"$lower": ["p_brand"]}, "n": {"$length": ["p_name"]}, "r": {"$reverse": ["p_name"]}, "t": {"$trim": ["p_type"]}}}, "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INTEGER) AS n, reverse(p_name) AS r, trim(p_type) AS t FROM part")
find("fn_initcap", "part", {}, {"select": {"p_partkey": 1, "i": {"$initcap": ["p_name"]}}}, "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS i FROM part")
find("fn_left_right_negative", "part", {}, {"select": {"p_partkey": 1, "a": {"$left": ["p_name", 3]}, "b": {"$left": ["p_name", -2]}, "c": {"$right": ["p_name", 3]}, "d": {"$right": ["p_name", -2]}}}, "SELECT p_partkey, left(p_name, 3) AS a, left(p_name, -2) AS b, right(p_name, 3) AS c, right(p_name, -2) AS d FROM part")
find("fn_position", "part", {}, {"select": {"p_partkey": 1, "a": {"$position": ["ring", "p_name"]}, "b": {"$position_lower": ["RING", "p_name"]}}}, "SELECT p_partkey, CAST(position('ring' IN p_name) AS INTEGER) AS a, CAST(position('ring' IN lower(p_name)) AS INTEGER) AS b FROM part")
find("fn_template_string", "customer", {}, {"select": {"c_custkey": 1, "t": {"$template_string": ["{c_name} in {c_mktsegment} {x}"]}}}, "SELECT c_custkey, c_name || ' in ' || c_mktsegment || ' {x}' AS t FROM customer")
find("fn_unnest_words", "part", {}, {"select": {"w": {"$unnest_words": ["p_name"]}, "n": {"$countAll": []}}}, "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
find("fn_md5_multi", "customer", {}, {"select": {"c_custkey": 1, "m": {"$md5": ["c_name"]}, "h": {"$md5_multi": ["c_custkey", "c_name"]}}}, "SELECT c_custkey, md5(c_name) AS m, md5(CAST(c_custkey AS VARCHAR) || c_name) AS h FROM customer")
find("fn_sha256_multi", "customer", {}, {"select": {"c_custkey": 1, "h": {"$sha256_multi": ["c_name", "c_mktsegment"]}}}, "SELECT c_custkey, sha256(c_name || c_mktsegment) AS h FROM customer")
query("fn_sha512_multi", None, "customer")(lambda e: e.find("customer", {}, {"select": {"c_custkey": 1, "h": {"$sha512_multi": ["c_name", "c_mktsegment"]}}, "limit": None}))
find("fn_rowhash", "nation", {}, {"select": {"n_nationkey": 1, "$rowhash": 1}}, "SELECT n_nationkey, md5(md5(n_name) || md5(CAST(n_nationkey AS VARCHAR)) || md5(CAST(n_regionkey AS VARCHAR))) AS \"$rowhash\" FROM nation")
find("fn_math", "customer", {}, {"select": {"c_custkey": 1, "c": {"$ceil": ["c_acctbal"]}, "f": {"$floor": ["c_acctbal"]}, "s": {"$sign": ["c_acctbal"]}, "r": {"$round": ["c_acctbal"]}}}, "SELECT c_custkey, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, CAST(sign(c_acctbal) AS DOUBLE) AS s, round_even(c_acctbal, 0) AS r FROM customer")

# -- dates ----------------------------------------------------------------------------------------

UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade")
find("date_trunc_units", "events", {}, {"select": {"event_id": 1, **{u: {f"$date_trunc_{u}": ["ts"]} for u in UNITS}}}, f"SELECT event_id, {', '.join(f'''CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS "{u}"''' for u in UNITS)} FROM events")
find("date_trunc_century", "orders", {}, {"select": {"o_orderkey": 1, "c": {"$date_trunc_century": ["o_orderdate"]}, "m": {"$date_trunc_millennium": ["o_orderdate"]}}}, "SELECT o_orderkey, make_timestamp(CAST(floor((year(o_orderdate) - 1) / 100) * 100 + 1 AS BIGINT), 1, 1, 0, 0, 0) AS c, make_timestamp(CAST(floor((year(o_orderdate) - 1) / 1000) * 1000 + 1 AS BIGINT), 1, 1, 0, 0, 0) AS m FROM orders")
BUCKET_SQL = ", ".join(f"time_bucket(INTERVAL '{n} {u}', ts, TIMESTAMP '2024-01-01') AS {u[0]}{n}" for u, ns in {"hour": (8, 4, 2), "minute": (30, 15, 6, 5, 4, 3, 2), "second": (30, 15, 10, 6, 5, 4, 3, 2)}.items() for n in ns)
find("date_trunc_buckets", "events", {}, {"select": {"event_id": 1, **{f"{u[0]}{n}": {f"$date_trunc_{n}{u}": ["ts"]} for u, ns in {"hour": (8, 4, 2), "minute": (30, 15, 6, 5, 4, 3, 2), "second": (30, 15, 10, 6, 5, 4, 3, 2)}.items() for n in ns}}}, f"SELECT event_id, {BUCKET_SQL} FROM events")
find("date_trunc_months", "orders", {}, {"select": {"o_orderkey": 1, **{f"m{n}": {f"$date_trunc_{n}month": ["o_orderdate"]} for n in (6, 4, 2)}}}, "SELECT o_orderkey, " + ", ".join(f"make_timestamp(year(o_orderdate), CAST(floor((month(o_orderdate) - 1) / {n}) * {n} + 1 AS BIGINT), 1, 0, 0, 0) AS m{n}" for n in (6, 4, 2)) + " FROM orders")
PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "dow", "isodow", "doy", "century", "decade", "millennium")
find("date_part_units", "events", {}, {"select": {"event_id": 1, **{f"p_{u}": {"$date_part": [u, "ts"]} for u in PARTS}}}, f"SELECT event_id, {', '.join(f'''CAST(date_part('{u}', ts) AS DOUBLE) AS p_{u}''' for u in PARTS)} FROM events")
FORMATS = {"date": "%Y-%m-%d", "datetime": "%Y-%m-%d %H:%M", "datetime_": "%Y_%m_%d__%H_%M", "timedate": "%H:%M %Y-%m-%d", "time": "%H:%M", "time12": "%I:%M", "timeAM": "%I:%M %p", "Dy": "%a", "Day": "%A", "DayNo": "%d", "DD": "%d", "MonthNo": "%m", "MM": "%m", "Mon": "%b", "Month": "%B", "year": "%Y", "yy": "%y", "yr": "%y"}
find("date_formats", "events", {}, {"select": {"event_id": 1, **{f"f_{k}_{i}": {f"${k}": ["ts"]} for i, k in enumerate(FORMATS)}}}, f"SELECT event_id, {', '.join(f'''strftime(ts, '{v}') AS f_{k}_{i}''' for i, (k, v) in enumerate(FORMATS.items()))} FROM events")
find("date_formats_lower", "events", {}, {"select": {"event_id": 1, "a": {"$dy": ["ts"]}, "b": {"$day": ["ts"]}, "c": {"$mon": ["ts"]}, "d": {"$month": ["ts"]}, "e": {"$dow": ["ts"]}, "f": {"$dowUS": ["ts"]}}}, "SELECT event_id, lower(strftime(ts, '%a')) AS a, lower(strftime(ts, '%A')) AS b, lower(strftime(ts, '%b')) AS c, lower(strftime(ts, '%B')) AS d, CAST(isodow(ts) AS VARCHAR) AS e, CAST(dayofweek(ts) + 1 AS VARCHAR) AS f FROM events")
query("date_difference", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(date_diff('second', o_orderdate, l_shipdate) AS BIGINT) AS secs FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "lineitem", "orders")(lambda e: line_dates(e).find("line_dates", {}, {"select": {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "l_suppkey": 1, "l_quantity": 1, "d": {"$difference": ["l_shipdate", "o_orderdate"]}}, "limit": None}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.expr("timestampdiff(SECOND, timestamp_ntz'2000-01-01', timestamp_ntz'2000-01-01' + d)").alias("secs")))


def line_dates(e: Engine) -> Engine:
    e.catalog.add("line_dates", e.catalog.table("lineitem").df.join(e.catalog.table("orders").df, F.expr("l_orderkey = o_orderkey")))
    return e


query("date_age", "SELECT l_orderkey, count(*) AS n, sum(date_part('year', age(greatest(o_orderdate, l_shipdate), least(o_orderdate, l_shipdate))) * 12 + date_part('month', age(greatest(o_orderdate, l_shipdate), least(o_orderdate, l_shipdate))))::BIGINT AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", "lineitem", "orders")(lambda e: line_dates(e).find("line_dates", {}, {"select": {"l_orderkey": 1, "a": {"$age": ["l_shipdate", "o_orderdate"]}}, "limit": None}).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("a.years") * 12 + F.col("a.months"))).cast("long").alias("months")))

# -- exists ---------------------------------------------------------------------------------------

find("exists_uncorrelated", "region", {"$exists": {"nation": {"n_name": "NATION_3"}}}, {}, "SELECT * FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_3')", "nation")
find("not_exists_uncorrelated", "region", {"$notExists": {"nation": {"n_name": "none"}}}, {}, "SELECT * FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'none')", "nation")
find("exists_one_hop", "customer", {"$existsJoined": {"orders": {"o_totalprice": {">": 450000}}}}, CUST, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", "orders")
find("not_exists_one_hop", "orders", {"$notExistsJoined": {"lineitem": {"l_quantity": {">": 10}}}}, {"select": ["o_orderkey"]}, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)", "lineitem")
find("exists_multi_hop", "customer", {"$existsJoined": {"orders.lineitem": {"l_quantity": 50, "l_returnflag": "R"}}}, CUST, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity = 50 AND l_returnflag = 'R')", "orders", "lineitem")
find("exists_wildcard", "lineitem", {"$existsJoined": {"**.region": {"r_name": "ASIA"}}}, {"select": {"l_orderkey": 1, "n": {"$countAll": []}}}, "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = l_suppkey AND r_name = 'ASIA') GROUP BY 1", "orders", "customer", "supplier", "nation", "region", "part")
find("exists_under_or", "customer", {"$or": [{"c_acctbal": {"<": -500}}, {"$existsJoined": {"orders": {"o_orderpriority": "1-URGENT", "o_totalprice": {">": 400000}}}}]}, CUST, "SELECT c_custkey FROM customer WHERE c_acctbal < -500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)", "orders")
find("exists_path_list", "nation", {"$existsJoined": {"path": ["customer", {"table": "orders", "on": [{"c_custkey": "o_custkey"}]}], "filter": {"o_totalprice": {">": 480000}}}}, {"select": ["n_nationkey"]}, "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 480000)", "customer", "orders")
find("not_exists_labels", "documents", {"$notExistsJoined": {"labels": {"quality": {"$in": [0, 1]}}}}, {"select": ["doc_id", "n_chars"]}, "SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality IN (0, 1))", "labels")

# -- nested joins ---------------------------------------------------------------------------------


def nested(name: str, table: str, params: dict, made: Callable[[DataFrame], DataFrame], sql: str, *others: str, wanted: dict | None = None, prepare: Callable[[Engine], Engine] | None = None) -> None:
    query(name, sql, table, *others)(lambda e: made((prepare(e) if prepare else e).find(table, wanted or {}, {"limit": None, **params})))


nested("nested_left_count", "orders", {"select": {"o_orderkey": 1, "lineitem": "*"}}, lambda d: d.select("o_orderkey", F.size("lineitem").cast("long").alias("n")), "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", "lineitem")
nested("nested_inner", "orders", {"select": {"o_orderkey": 1, "lines": {"$innerJoin": "lineitem", "select": {"l_quantity": 1}}}}, lambda d: d.select("o_orderkey", F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("qty")), "SELECT o_orderkey, sum(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", "lineitem")
nested("nested_filter", "customer", {"select": {"c_custkey": 1, "big": {"$leftJoin": "orders", "select": ["o_orderkey"], "filter": {"o_totalprice": {">": 400000}}}}}, lambda d: d.select("c_custkey", F.size("big").cast("long").alias("n")), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1", "orders")
TOP = "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn), '') AS ids FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) ON o_custkey = c_custkey AND {} GROUP BY 1"
nested("nested_top_n", "customer", {"select": {"c_custkey": 1, "top": {"$leftJoin": "orders", "select": ["o_orderkey"], "orderBy": [{"o_totalprice": -1}, {"o_orderkey": 1}], "limit": 3}}}, lambda d: d.select("c_custkey", joined(F.col("top"), "o_orderkey").alias("ids")), TOP.format("rn <= 3"), "orders")
nested("nested_offset", "customer", {"select": {"c_custkey": 1, "top": {"$leftJoin": "orders", "select": ["o_orderkey"], "orderBy": [{"o_totalprice": -1}, {"o_orderkey": 1}], "limit": 2, "offset": 1}}}, lambda d: d.select("c_custkey", joined(F.col("top"), "o_orderkey").alias("ids")), TOP.format("rn BETWEEN 2 AND 3"), "orders")
nested("nested_order", "nation", {"select": {"n_nationkey": 1, "s": {"$leftJoin": "supplier", "select": ["s_suppkey"], "orderBy": {"s_suppkey": -1}}}}, lambda d: d.select("n_nationkey", joined(F.col("s"), "s_suppkey").alias("ids")), "SELECT n_nationkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey DESC), '') AS ids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1", "supplier")
nested("nested_agg", "customer", {"select": {"c_custkey": 1, "o": {"$leftJoin": "orders", "select": {"o_orderstatus": 1, "n": {"$countAll": []}}, "orderBy": "o_orderstatus"}}}, lambda d: d.select("c_custkey", F.explode("o").alias("o")).select("c_custkey", "o.o_orderstatus", "o.n"), "SELECT c_custkey, o_orderstatus, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL", "orders")
nested("nested_having", "customer", {"select": {"c_custkey": 1, "o": {"$innerJoin": "orders", "select": {"o_orderstatus": 1, "n": {"$countAll": []}}, "having": {"n": {">": 4}}}}}, lambda d: d.select("c_custkey", F.explode("o").alias("o")).select("c_custkey", "o.o_orderstatus", "o.n"), "SELECT c_custkey, o_orderstatus, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) > 4", "orders")
query("nested_sort_parent", "SELECT c_custkey, m, row_number() OVER (ORDER BY m DESC NULLS FIRST, c_custkey) AS place FROM (SELECT c_custkey, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)", "customer", "orders")(lambda e: placed(e.find("customer", {}, {"select": {"c_custkey": 1, "orders": {"m": {"$max": ["o_totalprice"]}}}, "orderBy": [{"orders.m": -1}, {"c_custkey": 1}], "limit": None}).select("c_custkey", F.get("orders", F.lit(0))["m"].alias("m"))))
nested("nested_repeat_alias", "customer", {"select": {"c_custkey": 1, "open": {"$leftJoin": "orders", "select": ["o_orderkey"], "filter": {"o_orderstatus": "O"}}, "done": {"$leftJoin": "orders", "select": ["o_orderkey"], "filter": {"o_orderstatus": "F"}}}}, lambda d: d.select("c_custkey", F.size("open").cast("long").alias("open"), F.size("done").cast("long").alias("done")), "SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS open, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", "orders")
nested("nested_two_hops", "customer", {"select": {"c_custkey": 1, "l": {"$leftJoin": ["orders", "lineitem"], "select": ["l_quantity"]}}}, lambda d: d.select("c_custkey", F.size("l").cast("long").alias("n")), "SELECT c_custkey, count(l_orderkey) AS n FROM customer LEFT JOIN (orders JOIN lineitem ON l_orderkey = o_orderkey) ON o_custkey = c_custkey GROUP BY 1", "orders", "lineitem")
nested("nested_shortest_path", "region", {"select": {"r_name": 1, "supplier": {"s_suppkey": 1}}}, lambda d: d.select("r_name", F.size("supplier").cast("long").alias("n")), "SELECT r_name, count(s_suppkey) AS n FROM region LEFT JOIN (nation JOIN supplier ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey GROUP BY 1", "nation", "supplier", "customer")


def second_edge(e: Engine) -> Engine:
    e.catalog.relate("supplier", "nation", {"s_suppkey": "n_nationkey"})
    return e


nested("nested_or_join", "nation", {"select": {"n_nationkey": 1, "s": {"$leftJoin": "supplier", "select": ["s_suppkey"], "orderBy": "s_suppkey"}}}, lambda d: d.select("n_nationkey", joined(F.col("s"), "s_suppkey").alias("ids")), "SELECT n_nationkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS ids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey OR s_suppkey = n_nationkey GROUP BY 1", "supplier", prepare=second_edge)


def self_edge(e: Engine) -> Engine:
    e.catalog.add("people", e.catalog.table("customer").df.select("c_custkey", F.floor(F.col("c_custkey") / 10).cast("long").alias("boss")), ["c_custkey"])
    e.catalog.edges["people"]["people"] = [(("c_custkey", "boss"),)]
    return e


query("nested_self_join", "WITH people AS (SELECT c_custkey, CAST(floor(c_custkey / 10) AS BIGINT) AS boss FROM customer) SELECT p.c_custkey, count(q.c_custkey) AS n FROM people p LEFT JOIN people q ON q.boss = p.c_custkey GROUP BY 1", "customer")(lambda e: self_edge(e).find("people", {}, {"select": {"c_custkey": 1, "team": {"$leftJoin": [{"table": "people"}], "select": ["c_custkey"]}}, "limit": None}).select("c_custkey", F.size("team").cast("long").alias("n")))

# -- JSON, full text, geometry --------------------------------------------------------------------


JSON_SQL = """(SELECT event_id, '{"list":["' || event_type || '","' || user_id || '"],"u":' || user_id || '}' AS doc, '["' || event_type || '","' || user_id || '"]' AS arr FROM events)"""


def with_arrays(e: Engine) -> Engine:
    e.catalog.add("events_array", e.catalog.table("events").df.select("event_id", F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("arr")), ["event_id"])
    return e


query("json_array_length", f"SELECT event_id, CAST(json_array_length(arr) AS INTEGER) AS n FROM {JSON_SQL}", "events")(lambda e: with_arrays(e).find("events_array", {}, {"select": {"event_id": 1, "n": {"$jsonb_array_length": ["arr"]}}, "limit": None}))
query("json_array_elements", f"SELECT event_id, unnest(json_extract_string(arr, '$[*]')) AS v FROM {JSON_SQL}", "events")(lambda e: with_arrays(e).find("events_array", {}, {"select": {"event_id": 1, "v": {"$jsonb_array_elements_text": ["arr"]}}, "limit": None}))
query("json_each", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events", "events")(lambda e: e.find("events", {}, {"select": {"event_id": 1, "kv": {"$jsonb_each_text": ["props"]}}, "limit": None}).select("event_id", "kv.key", "kv.value"))
find("json_object_keys", "events", {}, {"select": {"event_id": 1, "k": {"$jsonb_object_keys": ["props"]}}}, "SELECT event_id, unnest(json_keys(props)) AS k FROM events")
find("json_typeof", "events", {}, {"select": {"t": {"$jsonb_typeof": ["props"]}, "n": {"$countAll": []}}}, "SELECT lower(json_type(props)) AS t, count(*) AS n FROM events GROUP BY 1")
find("json_build_object", "nation", {}, {"select": {"n_nationkey": 1, "o": {"$jsonb_build_object": ["n_nationkey", "n_name"]}}}, "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS o FROM nation")
find("json_set", "events", {}, {"select": {"event_id": 1, "j": {"$jsonb_set": ["props", ["x"], 1]}}}, "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"x\":1}' AS j FROM events")
find("json_path_query", "events", {}, {"select": {"event_id": 1, "v": {"$jsonb_path_query": ["props", "$.k"]}}}, "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
keys_where("fts_match", "documents", "doc_id", {"text.@@.to_tsquery": ["the & (and | of) & !que"]}, "list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the']) AND list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['and', 'of']) AND NOT list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['que'])")
keys_where("fts_plain", "documents", "doc_id", {"text": {"@@": {"plainto_tsquery": ["The that"]}}}, "list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'that'])")
find("fts_headline", "part", {}, {"select": {"p_partkey": 1, "h": {"$ts_headline": ["p_name", "ring"]}}}, "SELECT p_partkey, regexp_replace(p_name, '\\bring\\b', '<b>ring</b>', 'g') AS h FROM part")
find("term_highlight_index", "part", {}, {"select": {"p_partkey": 1, "i": {"$term_highlight": [["p_name"], "RING", {"returnType": "index"}]}}}, "SELECT p_partkey, CAST(position('ring' IN lower('p_name: ' || p_name)) - 1 AS INTEGER) AS i FROM part")
find("term_highlight_text", "part", {"p_name": {"$like": "%ring%"}}, {"select": {"p_partkey": 1, "h": {"$term_highlight": [["p_name"], "ring", {"noFields": True}]}}}, "SELECT p_partkey, '[\"' || left(p_name, position('ring' IN p_name) - 1) || '\",[\"ring\"],\"' || substr(p_name, position('ring' IN p_name) + 4) || '\"]' AS h FROM part WHERE p_name LIKE '%ring%'")
find("term_highlight_bool", "part", {}, {"select": {"p_partkey": 1, "b": {"$term_highlight": [["p_name", "p_type"], "small", {"returnType": "boolean"}]}}}, "SELECT p_partkey, (p_name ILIKE '%small%' OR p_type ILIKE '%small%') AS b FROM part")
keys_where("term_highlight_filter", "part", "p_partkey", {"$term_highlight": [["p_name"], "Widget", {"returnType": "boolean"}]}, "p_name ILIKE '%widget%'")


def with_points(e: Engine) -> Engine:
    df = e.catalog.table("customer").df.select("c_custkey", F.struct(((F.col("c_custkey") % 360) - 180).cast("double").alias("lng"), ((F.col("c_custkey") % 170) - 85).cast("double").alias("lat")).alias("at"))
    e.catalog.add("places", df, ["c_custkey"])
    return e


HAVERSINE = "(SELECT c_custkey, lng, lat, 2 * 6370986.0 * asin(sqrt(least(1.0, pow(sin((radians(51.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * pow(sin((radians(-0.1) - radians(lng)) / 2), 2)))) AS d FROM (SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lng, CAST(c_custkey % 170 - 85 AS DOUBLE) AS lat FROM customer))"
LONDON = {"lat": 51.5, "lng": -0.1}
query("geo_dwithin", f"SELECT c_custkey FROM {HAVERSINE} WHERE d <= 2500000", "customer")(lambda e: with_points(e).find("places", {"$ST_DWithin": ["at", {**LONDON, "distance": 2500, "unit": "km"}]}, {"select": ["c_custkey"], "limit": None}))
query("geo_distance_sphere", f"SELECT c_custkey, round(d) AS d FROM {HAVERSINE}", "customer")(lambda e: with_points(e).find("places", {}, {"select": {"c_custkey": 1, "d": {"$ST_DistanceSphere": ["at", LONDON]}}, "limit": None}).select("c_custkey", F.round("d").alias("d")))
query("geo_envelope", "SELECT c_custkey FROM customer WHERE c_custkey % 360 - 180 BETWEEN -10 AND 30 AND c_custkey % 170 - 85 BETWEEN 0 AND 50", "customer")(lambda e: with_points(e).find("places", {"at": {"&&": {"st_makeenvelope": [-10, 0, 30, 50]}}}, {"select": ["c_custkey"], "limit": None}))
query("geo_extent", "SELECT CAST(min(c_custkey % 360 - 180) AS DOUBLE) AS x0, CAST(max(c_custkey % 170 - 85) AS DOUBLE) AS y1 FROM customer", "customer")(lambda e: with_points(e).find("places", {}, {"select": {"x0": {"$ST_XMin_Agg": ["at"]}, "y1": {"$ST_YMax_Agg": ["at"]}}}))
query("geo_text", "SELECT c_custkey, 'POINT(' || (c_custkey % 360 - 180) || ' ' || (c_custkey % 170 - 85) || ')' AS w FROM customer", "customer")(lambda e: with_points(e).find("places", {}, {"select": {"c_custkey": 1, "w": {"$ST_AsText": ["at"]}}, "limit": None}))

# -- rules ----------------------------------------------------------------------------------------


def ruled(e: Engine, **rules: SelectRule) -> Engine:
    return e.as_caller({t: TableRules(select=r) for t, r in rules.items()})


query("rule_forced_filter", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0", "customer")(lambda e: ruled(e, customer=SelectRule(forced_filter={"c_nationkey": 3})).find("customer", {"c_acctbal": {">": 0}}, {"select": ["c_custkey"], "limit": None}))
query("rule_field_subset", "SELECT c_custkey, c_mktsegment FROM customer", "customer")(lambda e: ruled(e, customer=SelectRule(fields={"c_custkey": 1, "c_mktsegment": 1})).find("customer", {}, {"limit": None}))
query("rule_max_limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7", "customer")(lambda e: ruled(e, customer=SelectRule(max_limit=7)).find("customer", {}, {"select": ["c_custkey"], "orderBy": "c_custkey", "limit": None}))
query("rule_nested_target", "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1", "nation", "customer")(lambda e: ruled(e, nation=SelectRule(), customer=SelectRule(fields=["c_custkey"], forced_filter={"c_acctbal": {">": 5000}})).find("nation", {}, {"select": {"n_nationkey": 1, "customer": "*"}, "limit": None}).select("n_nationkey", F.size("customer").cast("long").alias("n")))


def scoped(e: Engine) -> DataFrame:
    rules = TableRules(select=SelectRule(fields={"c_name": 0}, forced_filter={"c_nationkey": {"<": 10}}))
    scope = TableRules(select=SelectRule(fields=["c_custkey", "c_name", "c_acctbal"], forced_filter={"c_mktsegment": "BUILDING"}))
    return e.as_caller({"customer": narrowed(rules, scope, e.catalog.table("customer").columns)}).find("customer", {}, {"limit": None})


query("scope_narrowing", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 10 AND c_mktsegment = 'BUILDING'", "customer")(scoped)

# -- writes ---------------------------------------------------------------------------------------


def state(e: Engine, table: str) -> DataFrame:
    return e.catalog.table(table).df


def write_insert_default(e: Engine) -> DataFrame:
    e.catalog.table("nation").defaults["n_regionkey"] = 4
    e.write.insert("nation", [{"n_nationkey": 100, "n_name": "NEW"}, {"n_nationkey": 101, "n_regionkey": 1}])
    return state(e, "nation")


def write_conflict(e: Engine, action: str) -> DataFrame:
    e.write.insert("nation", [{"n_nationkey": 3, "n_name": "CHANGED"}, {"n_nationkey": 100, "n_name": "NEW"}], on_conflict=action)
    return state(e, "nation")


def write_update_filter(e: Engine) -> DataFrame:
    e.write.update("customer", {"c_acctbal": {"<": 0}, "$existsJoined": {"nation": {"n_regionkey": 2}}}, {"c_mktsegment": "LATE"})
    return state(e, "customer").select("c_custkey", "c_mktsegment")


def write_delete_filter(e: Engine) -> DataFrame:
    e.write.delete("customer", {"c_mktsegment": "BUILDING", "c_acctbal": {">": 1000}})
    return state(e, "customer").select("c_custkey")


def write_upsert(e: Engine) -> DataFrame:
    e.write.upsert("nation", {"n_nationkey": 3}, {"n_name": "UPDATED"})
    e.write.upsert("nation", {"n_nationkey": 200}, {"n_name": "INSERTED", "n_regionkey": 0})
    return state(e, "nation")


query("write_insert_default", "SELECT * FROM nation UNION ALL SELECT 100, 'NEW', 4 UNION ALL SELECT 101, NULL, 1", "nation")(write_insert_default)
query("write_on_conflict_nothing", "SELECT * FROM nation UNION ALL SELECT 100, 'NEW', NULL", "nation")(lambda e: write_conflict(e, "DoNothing"))
query("write_on_conflict_update", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'NEW', NULL", "nation")(lambda e: write_conflict(e, "DoUpdate"))
query("write_update_filter", "SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'LATE' ELSE c_mktsegment END AS c_mktsegment FROM customer", "customer", "nation")(write_update_filter)
query("write_update_returning", "SELECT c_custkey, 'LATE' AS c_mktsegment FROM customer WHERE c_acctbal < 0", "customer")(lambda e: e.write.update("customer", {"c_acctbal": {"<": 0}}, {"c_mktsegment": "LATE"}, returning=["c_custkey", "c_mktsegment"]))
query("write_delete_filter", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 1000)", "customer")(write_delete_filter)
query("write_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'UPDATED' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 200, 'INSERTED', 0", "nation")(write_upsert)

# -- live queries, synchronisation, validation ----------------------------------------------------


def live_changed_rows(e: Engine) -> DataFrame:
    from quillon.streaming.live import changed_rows

    row = F.struct("*")
    feed = e.catalog.table("customer").df.select(F.lit("update").alias("op"), row.alias("before"), F.struct("c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") - 1000).alias("c_acctbal"), "c_mktsegment").alias("after"))
    return changed_rows(feed, F.col("c_acctbal") < 0, ()).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


query("live_changed_rows", "SELECT 'before' AS side, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'after', count(*) FROM customer WHERE c_acctbal - 1000 < 0", "customer")(live_changed_rows)


def live_changed_columns(e: Engine) -> DataFrame:
    from quillon.streaming.live import changed_columns

    """Rows divisible by 5 are new, of the others those divisible by 7 are gone: every row is in a state or both."""
    before = e.catalog.table("supplier").df.where("s_suppkey % 5 <> 0")
    after = e.catalog.table("supplier").df.where("s_suppkey % 7 <> 0 OR s_suppkey % 5 = 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return changed_columns(before, after, ["s_suppkey"], ["s_name", "s_acctbal"]).select("s_suppkey", "op", F.array_join("changed", ",").alias("changed"))


query("live_changed_columns", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'insert' WHEN s_suppkey % 7 = 0 THEN 'delete' ELSE 'update' END AS op, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 's_name,s_acctbal' ELSE 's_acctbal' END AS changed FROM supplier WHERE (s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 2 = 0)", "supplier")(live_changed_columns)


def sync_lww_merge(e: Engine) -> DataFrame:
    """Every event is in one of both states: those divisible by 3 on the server, the others come in."""
    from quillon.streaming.sync import SyncChannel, merge

    events = e.catalog.table("events").df.select("user_id", "event_id", "event_type")
    last = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))
    return merge(last(events.where("event_id % 3 = 0")), events.where("event_id % 3 <> 0"), SyncChannel(("user_id",), "event_id"))


query("sync_lww_merge", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1", "events")(sync_lww_merge)


def live_tracked_columns(e: Engine) -> DataFrame:
    """What a subscription under $and and an order tracks, beside what it selects."""
    from quillon.streaming.live import LiveQueries

    found = LiveQueries(e).subscribe("customer", {"$and": [{"c_mktsegment": "BUILDING"}]}, {"select": ["c_custkey"], "orderBy": {"c_acctbal": -1}, "limit": 1}, print, skip_first=True)
    return e.spark.createDataFrame([(c,) for c in sorted(found.columns)], "tracked string")


query("live_tracked_columns", "SELECT unnest(['c_acctbal', 'c_custkey', 'c_mktsegment']) AS tracked", "customer")(live_tracked_columns)


def rule_update_forced_filter(e: Engine) -> DataFrame:
    c = e.as_caller({"customer": TableRules(SelectRule(), None, UpdateRule(forced_filter={"c_mktsegment": "BUILDING"}, filter_fields=["c_acctbal"]))})
    c.write.update("customer", {"c_acctbal": {"$lt": 0}}, {"c_acctbal": 0})
    return e.find("customer", {}, {"select": ["c_custkey", "c_acctbal"], "limit": None})


query("rule_update_forced_filter", "SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer", "customer")(rule_update_forced_filter)


def rule_exists_in_delete(e: Engine) -> DataFrame:
    """A caller may see cheap orders alone; a delete of customers with orders tests these alone."""
    c = e.as_caller({"customer": TableRules(SelectRule(), None, None, DeleteRule()), "orders": TableRules(SelectRule(forced_filter={"o_totalprice": {"$lt": 5000}}))})
    c.write.delete("customer", {"$existsJoined": {"orders": {}}})
    return e.find("customer", {}, {"select": ["c_custkey"], "limit": None})


query("rule_exists_in_delete", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 5000)", "customer", "orders")(rule_exists_in_delete)


def json_schema_valid_rows(e: Engine) -> DataFrame:
    from quillon.functions.json_schema import is_valid

    return e.catalog.table("events").df.where(is_valid(F.col("props"), {"type": {"k": {"enum": list(range(50))}}})).select("event_id")


query("json_schema_valid_rows", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) < 50", "events")(json_schema_valid_rows)
query("raw_sql_params", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY 1", "customer")(lambda e: e.sql("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > :least GROUP BY 1", {"least": 1000}))

# -- flagship -------------------------------------------------------------------------------------

FLAGSHIP = (
    "customer",
    {"c_mktsegment": "BUILDING", "c_acctbal": {"$gt": 0}, "$existsJoined": {"orders": {"o_totalprice": {"$gt": 200000}}}},
    {
        "select": {"c_custkey": 1, "c_name": 1, "top": {"$leftJoin": "orders", "select": {"o_orderkey": 1, "o_totalprice": 1}, "orderBy": [{"o_totalprice": -1}, {"o_orderkey": 1}], "limit": 2}},
        "orderBy": [{"c_acctbal": -1}, {"c_custkey": 1}],
        "limit": 10,
    },
)
nested("flagship", FLAGSHIP[0], FLAGSHIP[2], lambda d: d.select("c_custkey", "c_name", joined(F.col("top"), "o_orderkey").alias("top")), "WITH picked AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) ORDER BY c_acctbal DESC, c_custkey LIMIT 10), ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT c_custkey, c_name, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn), '') AS top FROM picked LEFT JOIN ranked ON o_custkey = c_custkey AND rn <= 2 GROUP BY 1, 2", "orders", wanted=FLAGSHIP[1])
