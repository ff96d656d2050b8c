"""Registered queries of the dialect, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsql.engine import Engine
from plainsql.functions.aggregates import appended, profile
from plainsql.plans.words import pipeline
from plainsql.sources.files import exists
from plainsql.sources.paths import json_values, xml_values
from plainsql.sources.sinks import lines

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine(spark: SparkSession, sf_dir: str, **options: object) -> Engine:
    e = Engine(spark, folder=sf_dir, **options)
    for t in TABLES:
        e.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return e


TEQ = "({0} = {1} or abs({0} - {1}) < 1e-9 * (abs({0}) + abs({1})))"

#: name -> dialect text (several statements between semicolons), SQL, options of the engine.
DIALECT: dict[str, tuple] = {
    "project_arith": ("select l_orderkey, l_extendedprice * (1 - l_discount) as rev, rev * (1 + l_tax) as gross from lineitem l where l_quantity < 10",
        "select l_orderkey, l_extendedprice * (1 - l_discount) as rev, l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross from lineitem where l_quantity < 10"),
    "select_without_from": ("select 1 + 2 * 3 as a, -4 - 5 as b, 'x' as c, 7 % 4 as d where 1 = 1", "select 7.0::double as a, -9.0::double as b, 'x' as c, 3.0::double as d"),
    "unknown_is_null": ("select r_name, nothing as n, type(nothing) as t, nothing + 1 as m from region r", "select r_name, null::varchar as n, 'none' as t, null::double as m from region"),
    "star_limit": ("select * from nation n order by n_nationkey desc limit 7", "select * from nation order by n_nationkey desc limit 7"),
    "filter_and_or_left_assoc": ("select l_orderkey, l_linenumber from lineitem l where l_quantity = 1 or l_quantity = 2 and l_discount > 0.05", "select l_orderkey, l_linenumber from lineitem where (l_quantity = 1 or l_quantity = 2) and l_discount > 0.05"),
    "filter_tolerant_eq": ("select l_orderkey, l_extendedprice from lineitem l where l_discount * 3 = 0.3", f"select l_orderkey, l_extendedprice from lineitem where {TEQ.format('(l_discount * 3)', '0.3::double')}"),
    "filter_tolerant_lt": ("select l_orderkey, l_discount from lineitem l where l_discount * 3 < 0.3 and l_tax >= 0.02", f"select l_orderkey, l_discount from lineitem where l_discount * 3 < 0.3::double and not {TEQ.format('(l_discount * 3)', '0.3::double')} and (l_tax >= 0.02::double or {TEQ.format('l_tax', '0.02::double')})"),
    "filter_exact_eq": ("select count() as n from lineitem l where l_discount * 3 == 0.3", "select count(*)::double as n from lineitem where l_discount * 3 = 0.3::double", {"aggregate": "final"}),
    "filter_comparators": ("select p_partkey from part p where p_size !> 20 and p_size !< 10 and p_size <> 15 and p_size != 16 and p_size => 11", "select p_partkey from part where p_size <= 20 and p_size >= 10 and p_size not in (15, 16) and p_size >= 11"),
    "filter_string_number_is_false": ("select n_name from nation n where not n_name = 5 and n_name > 'J'", "select n_name from nation where n_name > 'J'"),
    "filter_not_null2v": ("select o_orderkey, o_totalprice % nothing as x from orders o where not (o_totalprice < nothing) and o_orderstatus = 'F'", "select o_orderkey, null::double as x from orders where o_orderstatus = 'F'"),
    "like_glob": ("select p_partkey, p_type from part p where p_type like '*A?*' and p_brand like 'B%'", "select p_partkey, p_type from part where p_type like '%A_%' and p_brand like 'B%'"),
    "ilike_glob": ("select p_partkey from part p where p_name ilike '*A_%'", "select p_partkey from part where p_name ilike '%A_%'"),
    "in_list": ("select n_name from nation n where n_regionkey in (1, 3) and n_nationkey not in (2, 4)", "select n_name from nation where n_regionkey in (1, 3) and n_nationkey not in (2, 4)"),
    "between": ("select p_partkey from part p where p_size between 5 and 9", "select p_partkey from part where p_size between 5 and 9"),
    "is_null": ("select count() as n from orders o where o_orderkey / (o_orderkey % 2) is null", "select count(*)::double as n from orders where o_orderkey % 2 = 0", {"aggregate": "final"}),
    "cross_theta_join": ("select n_name, r_name from nation n, region r where n_regionkey < r_regionkey and n_name > r_name", "select n_name, r_name from nation, region where n_regionkey < r_regionkey and n_name > r_name"),
    "equi_join_where": ("select o_orderkey, c_name, o_totalprice from orders o, customer c where o_custkey = c_custkey and c_acctbal > 9000", "select o_orderkey, c_name, o_totalprice from orders, customer where o_custkey = c_custkey and c_acctbal > 9000"),
    "join_on_col": ("set k = 20; create view big as select l_orderkey as o_orderkey, l_quantity from lineitem l where l_quantity > k; select o_orderkey, o_orderstatus, l_quantity from orders o join big b on o_orderkey", "select o_orderkey, o_orderstatus, l_quantity from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 20"),
    "self_join": ("select a.c_custkey as x, b.c_custkey as y from customer a, customer b where a.c_nationkey = b.c_nationkey and a.c_custkey < b.c_custkey and a.c_mktsegment = b.c_mktsegment", "select a.c_custkey as x, b.c_custkey as y from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_custkey < b.c_custkey and a.c_mktsegment = b.c_mktsegment"),
    "tolerant_double_join": ("select o_orderkey, l_linenumber from orders o, lineitem l where o_totalprice = l_extendedprice", f"select o_orderkey, l_linenumber from orders join lineitem on abs(o_totalprice - l_extendedprice) < 1 where {TEQ.format('o_totalprice', 'l_extendedprice')}"),
    "generator_int": ("select i, i * i as sq from int(1, 1000) i", "select i::double as i, (i * i)::double as sq from range(1, 1001) t(i)"),
    "generator_num_step": ("select round2 as x from num(0, 2, 0.25) round2", "select (0.25 * i)::double as x from range(0, 9) t(i)"),
    "generator_correlated": ("select i, j from int(1, 20) i, int(1, i) j", "select i::double as i, j::double as j from range(1, 21) a(i), range(1, 21) b(j) where j <= i"),
    "theta_join_generators": ("select i, j from int(1, 1000) i, int(1, 1000) j where i = j", "select i::double as i, i::double as j from range(1, 1001) t(i)"),
    "divisor_search": ("select i, j from int(2, 100) i, int(1, 2124680) j where 2124680 % j = 0", "select i::double as i, j::double as j from range(2, 101) a(i), range(1, 2124681) b(j) where 2124680 % j = 0"),
    "join_three_mixed": ("select o_orderkey, n_name, s_suppkey from orders o, supplier s, nation n, customer c where o_custkey = c_custkey and c_nationkey = n_nationkey and s_nationkey = n_nationkey and s_acctbal > 9000 and o_totalprice > 300000",
        "select o_orderkey, n_name, s_suppkey from orders, supplier, nation, customer where o_custkey = c_custkey and c_nationkey = n_nationkey and s_nationkey = n_nationkey and s_acctbal > 9000 and o_totalprice > 300000"),
    "format_csv": ("format csv select n_nationkey as k, n_name as name, nothing as x from nation n where n_nationkey < 9", "select n_nationkey || ',' || n_name || ',' as \"k,name,x\" from nation where n_nationkey < 9"),
    "cross_generators_mod": ("select i, j from int(2, 100) i, int(1, 2000) j where j % i = 0 and 2124680 % j = 0", "select i::double as i, j::double as j from range(2, 101) a(i), range(1, 2001) b(j) where j % i = 0 and 2124680 % j = 0"),
    "agg_final": ("select count() as n, sum(l_quantity) as s, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem l", "select count(*)::double as n, sum(l_quantity) as s, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem", {"aggregate": "final"}),
    "agg_count_variants": ("select count(nothing) as a, count(o_orderstatus) as b, count(o_totalprice) as c, sum(o_orderstatus) as d from orders o", "select 0::double as a, count(o_orderstatus)::double as b, count(o_totalprice)::double as c, 0::double as d from orders", {"aggregate": "final"}),
    "agg_running": ("select event_id, count() as n, count(value) as m, min(value) as lo, max(value) as hi from events e", "select event_id, row_number() over w::double as n, count(value) over w::double as m, min(value) over w as lo, max(value) over w as hi from events window w as (order by event_id rows unbounded preceding)", {"order_by": "event_id"}),
    "group_by_positional": ("select l_returnflag, l_linestatus, count() as n, sum(l_quantity) as q from lineitem l group by 1, 2 order by 1, 2", "select l_returnflag, l_linestatus, count(*)::double as n, sum(l_quantity) as q from lineitem group by 1, 2"),
    "having": ("select o_custkey, count() as n from orders o group by o_custkey having n > 15", "select o_custkey, count(*)::double as n from orders group by o_custkey having count(*) > 15"),
    "order_by_ordinal_desc_limit": ("select o_orderkey, o_totalprice from orders o order by -2, 1 limit 50", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50"),
    "lineno": ("select $lineno as line, event_id from events e", "select row_number() over (order by event_id)::double as line, event_id from events", {"order_by": "event_id"}),
    "str_functions": ("select p_partkey, ascii(p_name) as a, char(65 + p_size % 26) as c, left(p_name, 3) as l, right(p_name, 4) as r, lower(p_brand) as lo, upper(p_name) as up, length(p_name) as n, trim(' x ') as t, charindex(p_name, 'a') as i from part p",
        "select p_partkey, ascii(p_name)::double as a, chr((65 + p_size % 26)::int) as c, left(p_name, 3) as l, right(p_name, 4) as r, lower(p_brand) as lo, upper(p_name) as up, strlen(p_name)::double as n, 'x' as t, instr(p_name, 'a')::double as i from part"),
    "str_more": ("select p_partkey, ltrim('  a ') as a, rtrim(' b  ') as b, replace(p_brand, 'B', 'b') as c, reverse(p_brand) as d, substring(p_name, 2, 3) as e, replicate('xy', 2) as f, str(p_size) as g, concat_ws('-', p_brand, p_size) as h from part p",
        "select p_partkey, 'a ' as a, ' b' as b, replace(p_brand, 'B', 'b') as c, reverse(p_brand) as d, substring(p_name, 2, 3) as e, 'xyxy' as f, p_size::varchar as g, p_brand || '-' || p_size as h from part"),
    "math_functions": ("select p_partkey, sqrt(p_size) as a, p_size ^ 2 as b, abs(-p_size) as c, ceil(p_retailprice) as d, floor(p_retailprice) as e, sign(-p_size) as f, sqr(p_size) as g, mod(p_size, 7) as h, div(p_size, 7) as i, isnan(p_size) as j, isfinite(p_size) as k, isinf(p_size) as m from part p",
        "select p_partkey, sqrt(p_size) as a, pow(p_size, 2)::double as b, p_size::double as c, ceil(p_retailprice) as d, floor(p_retailprice) as e, -1.0::double as f, (p_size * p_size)::double as g, (p_size % 7)::double as h, (p_size // 7)::double as i, 0::double as j, 1::double as k, 0::double as m from part"),
    "bit_ops": ("select p_partkey, p_partkey & 7 as a, p_partkey | 8 as b, xor(p_partkey, 5) as c from part p", "select p_partkey, (p_partkey & 7)::double as a, (p_partkey | 8)::double as b, xor(p_partkey, 5)::double as c from part"),
    "human_literals": ("select 2k + 0 as a, 3Mi + 0 as b, 1h + 5da as c, 4G / 2 as d, 5d * 2 as e", "select 2000::double as a, 3145728::double as b, 150::double as c, 2e9::double as d, 1::double as e"),
    "type_of": ("select p_partkey, type(p_size) as a, type(p_name) as b, type(p_size / 4) as c from part p", "select p_partkey, 'int' as a, 'str' as b, case when p_size % 4 = 0 then 'int' else 'num' end as c from part"),
    "concat_null_skip": ("select o_orderkey, concat(o_orderstatus, nothing, '-', o_orderkey) as c, add(o_custkey, nothing, 1) as d, plus(o_custkey, 1) as e from orders o", "select o_orderkey, concat(o_orderstatus, null, '-', o_orderkey) as c, (o_custkey + 1)::double as d, (o_custkey + 1)::double as e from orders"),
    "mixed_arithmetic": ("select n_nationkey, 42 + n_name as a, n_name + 42 as b from nation n", "select n_nationkey, 42::double as a, n_name as b from nation"),
    "column_pattern": ("select [n.*key] from nation n", 'select n_nationkey as "n.n_nationkey", n_regionkey as "n.n_regionkey" from nation'),
    "view_table": ("create view rich as select c_custkey, c_acctbal from customer c where c_acctbal > 5000; select count() as n, max(c_acctbal) as m from rich r", "select count(*)::double as n, max(c_acctbal) as m from customer where c_acctbal > 5000", {"aggregate": "final"}),
    "table_function": ("create function above(x) as select o_orderkey from orders o where o_totalprice > x; select o_orderkey from above(300k) a", "select o_orderkey from orders where o_totalprice > 300000"),
    "set_variable": ("set @a = 2 * 3; select p_partkey, p_size * @a as x from part p where p_size < @a", "select p_partkey, (p_size * 6)::double as x from part where p_size < 6"),
    "index_report": ("create index ix on lineitem(l_partkey)", "select 'ix' as name, count(l_partkey) as entries, count(distinct l_partkey) as distinct_keys, min(l_partkey)::varchar as least, max(l_partkey)::varchar as most from lineitem"),
    "like_in_names": ("select n_nationkey, n_name, like(n_name, '*A') as a, ilike(n_name, 'a%') as b from nation n where n_name like '?*A*'", "select n_nationkey, n_name, (n_name like '%A')::int::double as a, (n_name ilike 'a%')::int::double as b from nation where n_name like '_%A%'"),
    "filter_case_blind": ("select n_nationkey from nation n where n_name ~= lower(n_name) and n_nationkey !> 20", "select n_nationkey from nation where n_nationkey <= 20"),
    "comparison_as_value": ("select p_partkey, p_size > 25 as big, not p_size = 7 as other from part p", "select p_partkey, p_size > 25 as big, p_size <> 7 as other from part"),
    "format_bar": ("format bar select n_nationkey as k, n_name as name from nation n", "select n_nationkey || '|' || n_name as \"k|name\" from nation"),
    "csv_fields": ("select o_orderkey, csvfield(concat(o_orderstatus, ',\"x, ', o_orderkey, '\",'), 2) as f, csvfield('a|b', 2, '|') as g, csvfield('a', 2) as h from orders o", "select o_orderkey, 'x, ' || o_orderkey as f, 'b' as g, null::varchar as h from orders"),
    "index_list": ("create index ix on nation(n_name); select * from $index i", "select 'ix' as name, 'nation' as \"table\", 'n_name' as \"column\""),
    "registered_tables": ("select name from $table a where type = 'table' and name in ('region', 'nation')", "select unnest(['region', 'nation']) as name"),
    "catalog_view": ("create view v as select r_name from region r; select type, name from $view a where type = 'view'", "select 'view' as type, 'v' as name"),
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def _dialect(text: str, options: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, **options).script(text)


def agg_running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir, order_by="event_id").sql("select event_id, sum(value) as s, avg(value) + 0.0000001 as a, stdev(value) + 0.0000001 as d from events e"), 4)


def agg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir).sql("select l_returnflag, avg(l_extendedprice) as a, stdev(l_quantity) as d, sum(l_extendedprice * (1 - l_discount)) as rev from lineitem l group by 1"), 2)


def math_transcendental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir).sql("select p_partkey, sin(p_size) as a, cos(p_size) as b, tan(p_size) as c, asin(1 / p_size) as d, acos(1 / p_size) as e, atan(p_size) as f, atan2(p_size, 2) as g, cbrt(p_size) as h, exp(p_size / 10) as i, log(p_size) as j, log10(p_size) as k, log2(p_size) as m, degrees(p_size) as n, radians(p_size) as o, pi() as p from part p"))


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("select event_id, jsonpath(props, 'k') as k from events e")


def json_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(json_values(F.concat(F.lit('{"a": ['), "props", F.lit("]}")), "a/k"), ",").alias("k"))


def xml_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nations.select("n_nationkey", F.array_join(xml_values(F.concat(F.lit("<x><a><n>"), "n_name", F.lit("</n></a><n>no</n></x>")), "a/n"), ",").alias("name"))


def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "event_id"), 4)


def pipeline_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline(spark, "1 to 10 sqr lt 55")


def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).describe("nation").select("name")


def text_file(spark: SparkSession, sf_dir: str, name: str, df: DataFrame) -> str:
    """The path of df as lines of csv, written once a session and input, in the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/plainsql-text/{spark.sparkContext.applicationId}/{crc32(sf_dir.encode())}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        lines(df, "csv").write.mode("overwrite").text(path)
    return path


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text of line items, scanned with a function for each row."""
    path = text_file(spark, sf_dir, "lineitem", spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice"))
    return engine(spark, sf_dir).sql(f'select orderkey, line, left(flag, 1) as f, quantity * 2 as q from "{path}"(orderkey,line,flag,quantity,price) t where price > 1000')


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with quotes, delimiters, backslashes, blanks and NULL in it, written as csv and read again."""
    note = F.concat(F.lit(' "'), "c_name", F.lit('", a\\b; \''), "c_mktsegment", F.lit("'"))
    odd = F.when(F.col("c_custkey") % 3 == 1, "NULL").when(F.col("c_custkey") % 3 == 2, "")
    path = text_file(spark, sf_dir, "notes", spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", note.alias("note"), odd.alias("odd"), "c_acctbal"))
    return engine(spark, sf_dir).sql(f'select k, note, odd, bal from "{path}"(k,note,odd,bal) t')


def paths_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both path functions in the dialect, on nested texts with decoys beside the path."""
    return engine(spark, sf_dir).sql("""select event_id, jsonpath(concat('{"z": {"k": 0}, "a": [{"b": ', props, '}]}'), '/a/k') as j, xmlpath(concat('<r><t>no</t><a><b><t>', event_type, '</t></b></a></r>'), 'a.t') as x from events e""")


def values_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each key put together in parts, and counted and summed again from those."""
    parts = appended(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_orderkey", piece=1000)
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x)).alias("s"), (F.max(F.size("values")) <= 1000).alias("bounded"))


def scanned_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback over batches of a statement's rows."""

    def doubled(frames):
        for f in frames:
            yield f.assign(q=f["q"] * 2)

    return engine(spark, sf_dir).scan("select l_orderkey as k, l_linenumber as line, l_quantity as q from lineitem l where l_quantity > 45", doubled, "k long, line long, q double")


OTHERS = {
    values_by_key: "select l_returnflag as key, count(*) as n, sum(l_orderkey)::bigint as s, true as bounded from lineitem group by 1",
    scanned_in_batches: "select l_orderkey as k, l_linenumber::bigint as line, l_quantity * 2 as q from lineitem where l_quantity > 45",
    csv_scan: "select l_orderkey::double as orderkey, l_linenumber::double as line, l_returnflag as f, l_quantity * 2 as q from lineitem where l_extendedprice > 1000",
    csv_round_trip: """select c_custkey::double as k, ' "' || c_name || '", a\\b; ''' || c_mktsegment || '''' as note, case when c_custkey % 3 = 1 then 'NULL' when c_custkey % 3 = 2 then '' end as odd, c_acctbal as bal from customer""",
    paths_in_sql: "select event_id, json_extract_string(props, '$.k') as j, event_type as x from events",
    agg_running_sums: "select event_id, round(sum(value) over w, 4) as s, round(avg(value) over w + 0.0000001, 4) as a, round(stddev_samp(value) over w + 0.0000001, 4) as d from events window w as (order by event_id rows unbounded preceding)",
    agg_moments: "select l_returnflag, round(avg(l_extendedprice), 2) as a, round(stddev_samp(l_quantity), 2) as d, round(sum(l_extendedprice * (1 - l_discount)), 2) as rev from lineitem group by 1",
    math_transcendental: "select p_partkey, round(sin(p_size), 6) as a, round(cos(p_size), 6) as b, round(tan(p_size), 6) as c, round(asin(1 / p_size), 6) as d, round(acos(1 / p_size), 6) as e, round(atan(p_size), 6) as f, round(atan2(p_size, 2), 6) as g, round(cbrt(p_size), 6) as h, round(exp(p_size / 10), 6) as i, round(ln(p_size), 6) as j, round(log10(p_size), 6) as k, round(log2(p_size), 6) as m, round(degrees(p_size), 6) as n, round(radians(p_size), 6) as o, round(pi(), 6) as p from part",
    json_path: "select event_id, json_extract_string(props, '$.k') as k from events",
    json_any_depth: "select event_id, json_extract_string(props, '$.k') as k from events",
    xml_path: "select n_nationkey, n_name as name from nation",
    profile_stats: "select count(event_id) as n, count(*) - count(event_id) as n_null, min(event_id)::double as min, max(event_id)::double as max, round(avg(event_id), 4) as avg, 0::bigint as n_str, max(event_id)::double as last, true as never_falls, count(*) < 2 as never_rises from events",
    pipeline_words: "select (i * i)::double as value from range(1, 11) t(i) where i * i < 55",
    describe_table: "select unnest(['n_nationkey', 'n_name', 'n_regionkey']) as name",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _dialect(x[0], x[2] if len(x) > 2 else {}) for name, x in DIALECT.items()} | {f.__name__: f for f in OTHERS}


def oracle_sql() -> dict[str, str]:
    return {name: x[1] for name, x in DIALECT.items()} | {f.__name__: sql for f, sql in OTHERS.items()}
