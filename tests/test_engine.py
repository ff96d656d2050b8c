"""The dialect, sources, sinks, streams and joins on small inline data."""

import io
import random

import pytest
from pyspark.sql import functions as F

from plainsql import Engine
from plainsql.__main__ import main
from plainsql.functions.aggregates import appended, profile
from plainsql.operators import joins
from plainsql.operators.joins import tolerant_join
from plainsql.plans.parser import SqlError, number, parse
from plainsql.plans.words import pipeline
from plainsql.sources import files, sinks
from plainsql.sources.paths import json_values, xml_values
from plainsql.streaming.aggregates import aggregated


def one(e, text):
    return tuple(e.sql(text).first())


def test_precedence_and_nulls(spark):
    e = Engine(spark)
    assert one(e, "select 1+2*3, 2*3+1, -1-2, null+1, missing") == (7.0, 7.0, -3.0, None, None)
    assert one(e, "select 7 % 4, -7 % 4, 1/0, 5 % 0") == (3.0, -3.0, None, None)
    assert one(e, "select 42+'FOO', 'FOO'+42, concat(1, null, 'a', 2.5)") == (42.0, "FOO", "1a2.5")
    assert e.sql("select 1 where 0.1+0.2 = 0.3").count() == 1 and e.sql("select 1 where 0.1+0.2 == 0.3").count() == 0
    assert e.sql("select 1 where not null = 1").count() == 1 and e.sql("select 1 where (1)=1 and (1=1)").count() == 1
    assert e.sql("select 1 where 1=1 or 1=1 and 1=2").count() == 0
    assert number("1.5k") == 1500 and number("2Ki") == 2048 and number("3n") == pytest.approx(3e-9)


def test_logic_is_left_associative(spark):
    r = random.Random(1)
    for _ in range(40):
        bits, ops = [r.random() < 0.5 for _ in range(5)], [r.choice(["and", "or"]) for _ in range(4)]
        want, text = bits[0], f"1={int(bits[0])}"
        for b, op in zip(bits[1:], ops):
            want, text = (want and b) if op == "and" else (want or b), f"{text} {op} 1={int(b)}"
        t = parse(f"select 1 where {text}")[1].where

        def truth(t):
            return t[2][1] == t[3][1] if t[0] == "cmp" else (truth(t[1]) and truth(t[2])) if t[0] == "and" else truth(t[1]) or truth(t[2])

        assert truth(t) == want


def test_errors(spark):
    e = Engine(spark)
    for bad in ("select left('a')", "select nofun(1)", "selec 1", "select 1 from nowhere n", "select 1 order by 3", "select a from \"ls |\"(a) x", "select 'open"):
        with pytest.raises(SqlError):
            e.sql(bad)


def test_delimited_files(spark, tmp_path):
    (tmp_path / "foo.csv").write_text('a,b,"c"\n1,"x, y",\n\n2,\\N,3.5\n3,NULL,4\n4\n')
    (tmp_path / "count.txt").write_text("1 a\n2 b\n")
    (tmp_path / "semi.csv").write_text("a;b\n1;2\n")
    (tmp_path / "ten.sql").write_text("select i from int(1,10) i")
    e = Engine(spark, folder=str(tmp_path))
    assert [tuple(r) for r in e.sql("select * from foo f order by a").collect()] == [(1.0, "x, y", None), (2.0, None, 3.5), (3.0, None, 4.0), (4.0, None, None)]
    assert [r[0] for r in e.sql("select fish from count.txt(fish) c").collect()] == ["1 a", "2 b"]
    assert one(e, "select a+b from semi s") == (3.0,)
    assert e.sql("select i from ten t where i > 4").count() == 6
    assert files.sniff("a,b;c") == ";" and files.sniff("abc") == "|"
    assert e.sql("select t1.a, t2.b from foo t1 join foo t2 on a").count() == 4
    sinks.write_text(e.sql("select a, b from foo f"), f"{tmp_path}/out", "bar")
    assert spark.read.csv(f"{tmp_path}/out", sep="|", header=True).count() == 4
    assert (sinks.human(1234567890.0).strip(), sinks.human(12.0).strip(), sinks.short("abcdefghij")) == ("1.235G", "12", "abcdef*")


def test_commands_need_leave(spark):
    e = Engine(spark, security=False)
    assert [r[0] for r in e.sql('select w from "seq 2 |"(w) c').collect()] == ["1", "2"]


def test_log(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n3,z\n")
    e = Engine(spark, folder=str(tmp_path), log=f"{tmp_path}/log")
    e.sql("select 1")
    with pytest.raises(SqlError):
        e.sql("select nofun()")
    ran = e.execute("select a from t x where a > 1")
    assert (ran.rows, ran.nfiles) == (2, 1) and ran.readrows == 4  # the header is a line, too
    log = spark.read.json(f"{tmp_path}/log").collect()
    assert sorted(r.state for r in log) == ["end", "error", "planned"]
    end = next(r for r in log if r.state == "end")
    assert (end.rows, end.readrows, end.nfiles, end.sql) == (2, 4, 1, "select a from t x where a > 1") and end.ms > 0


def printed(spark, arguments, lines=""):
    out = io.StringIO()
    return main(arguments, spark, io.StringIO(lines), out), out.getvalue()


def test_command_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,foobarfoo\n2000000,\n")
    (tmp_path / "init.txt").write_text("--no-stats\ncreate view big as select a from t x where a > 5\n")
    folder = f"--folder={tmp_path}"
    code, text = printed(spark, [folder, "--batch", "select a, b from t x", "select count() as n from t x where a > 5"])
    assert (code, text) == (0, "a,b\n1,foobarfoo\n2000000,\nn\n1\n")
    code, text = printed(spark, [folder, "--no-echo", "select a, b, a as c from t x"])
    assert code == 0 and text.splitlines()[:4] == ["a\tb\tc", "======= ======= ======= ", "      1\tfoobar*\t      1", " 2e+06\tNULL\t 2e+06".replace(" 2e+06", "     2M")]
    assert text.splitlines()[-1].startswith("2 rows in ") and text.endswith("(read 3 lines)\n")
    code, text = printed(spark, [folder, "--init", f"{tmp_path}/init.txt", "--batch", "select a from big x"])
    assert code == 0 and text.endswith("a\n2000000\n")
    assert printed(spark, ["--no-echo", "select nofun()", "select 1 as x"]) == (1, "% no function nofun\n")
    code, text = printed(spark, ["--batch", "--force", "select nofun()", "select 1 as x"])
    assert code == 0 and text.endswith("x\n1\n")
    code, text = printed(spark, ["--interactive"], "select nofun()\n\nselect 1 as x\nquit\nselect 2 as y\n")
    assert code == 0 and "nofun" in text and "      1" in text and "y" not in text.split("nofun\n")[1]
    assert printed(spark, ["--batch"], "select 'a,b' as x\nexit\n") == (0, 'x\n"a,b"\n')
    with pytest.raises(SystemExit):
        printed(spark, ["--what"])


def test_patterns_in_columns(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([("abc", "a*"), ("abc", "A?C"), ("a\\b", "a\\*"), ("x", None), ("a\nb", "a_b")], "s string, p string"))
    assert [r[0] for r in e.sql("select like(s, p) as x from t y").collect()] == [1, 0, 1, 0, 1]
    assert [r[0] for r in e.sql("select ilike(s, p) as x from t y").collect()] == [1, 1, 1, 0, 1]
    assert e.sql("select s from t y where s like p").count() == 3


def test_functions_of_text_that_is_no_number(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([("4",), ("abc",), ("",), (None,)], "s string"))
    names = "abs sqrt sin cos exp ln log10 floor ceil sign sqr degrees".split()
    rows = [tuple(r) for r in e.sql(f"select {', '.join(f'{n}(s) as {n}' for n in names)}, add(s, 1) as a, mod(s, 3) as m, left('xyz', s) as l from t y").collect()]
    assert rows[0][:2] == (4.0, 2.0) and rows[0][-3:] == (5.0, 1.0, "xyz")
    assert all(set(r[: len(names)]) == {None} and r[-3:] == (1.0, None, None) for r in rows[1:])
    assert e.sql("select s from t y where s").count() == 1


def test_xml_that_is_not_well_formed(spark):
    texts = ["<a><b>1<c/>2</b><x:b>no</x:b><d><b>3</b></d></a>", "<a><b>1</b>", "plain b", "", None, "<b><a>4</a></b>", "<a><b><b>5</b></b></a>", "<a><b>é &amp; <![CDATA[<b>]]></b></a>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r.v for r in df.select("i", xml_values(F.col("s"), "a/b").alias("v")).orderBy("i").collect()]
    assert got == [["1", "2", "3"], [], [], [], None, [], ["5"], ["é & <b>"]]


def test_human_numbers():
    given = [12345, 123456, 1234567, 123456789, 0.0004, 0.00005, 1.2e5, 9.9e99, 0, -12345, -0.00005, -1.2e5, -3, 1e6, 3e6, 6e18, 1 << 20, 2048, 3 << 20, 6 << 60, None]
    want = "12345 123456 1.235M 123.5M 0.0004 5e-05 120000 9.9e+99 0 -12.35k -50u -120k -3 1000000 3M 6E 1.049M 2048 3Mi 6Ei NULL".split()
    assert [sinks.human(x).strip() for x in given] == want


def test_listings(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x\n1\n2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "v.sql").write_text("select 1")
    e = Engine(spark, folder=str(tmp_path))
    e.register("t", spark.range(3))
    e.sql("create view w as select 1")
    e.sql("create index ix on t(id)")
    assert {tuple(r) for r in e.sql("select type, name, lines from $table a").collect()} == {("table", "t", None), ("view", "w", None), ("view", "v.sql", None), ("table", "a b.csv", 3), ("table", "empty.csv", 0)}
    assert [tuple(r) for r in e.sql("select * from $index a").collect()] == [("ix", "t", "id")]


def test_exact_text_of_numbers(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(0.1,), (2.0,), (1e300,), (-0.5,), (None,)], "x double"))
    assert [r[0] for r in e.sql("select concat('a', x) as c from t y").collect()] == [f"a{0.1:.31g}", "a2", f"a{1e300:.31g}", "a-0.5", "a"]
    assert one(e, "select concat(null, 'foo', 12345678901234567890, 'bar')") == ("foo12345678901234567168bar",)


def test_fields_of_a_line(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([('a,"b ""c"", d", 7,',), ("",), (None,), ("x",)], "s string"))
    assert [tuple(r) for r in e.sql("select csvfield(s, 1), csvfield(s, 2), csvfield(s, 3), csvfield(s, 4), csvfield(s, 9) from t y").collect()] == [("a", 'b "c", d', "7", None, None), (None,) * 5, (None,) * 5, ("x", None, None, None, None)]
    assert one(e, "select from_csv('a|b', 2, '|')") == ("b",)
    with pytest.raises(SqlError):
        e.sql("select csvfield('a', 1, 'xx')")


def test_callbacks(spark):
    e = Engine(spark)
    e.register("t", spark.range(10))
    seen = spark.sparkContext.accumulator(0)
    e.each("select id from t x where id > 6", lambda r: seen.add(r.id))
    assert seen.value == 24
    twice = lambda frames: (f * 2 for f in frames)
    assert sorted(r.id for r in e.scan("select id from t x where id < 3", twice, "id long").collect()) == [0, 2, 4]


def test_appended(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i}", i if i % 5 else None) for i in range(500)]
    got = appended(spark.createDataFrame(rows, "k string, v int").repartition(3), "k", "v", piece=20).collect()
    assert all(r.n == len(r["values"]) <= 20 for r in got)
    for key in {k for k, _ in rows}:
        mine = sorted((r for r in got if r.key == key), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(len(mine)))
        assert sorted((v for r in mine for v in r["values"]), key=str) == sorted((v for k, v in rows if k == key), key=str)
    assert appended(spark.createDataFrame([], "k string, v int"), "k", "v").count() == 0


def test_profile_of_mixed_text(spark):
    df = spark.createDataFrame([(1, "3"), (2, None), (3, "x"), (4, "5"), (5, "y")], "i int, c string")
    r = profile(df, "c", "i").first()
    assert (r.n, r.n_null, r.n_str, r.min, r.max, r.last) == (2, 1, 2, 3.0, 5.0, 5.0)


def test_running_above_a_join(spark):
    e = Engine(spark)
    e.register("t", spark.range(2000).withColumn("v", F.rand()))
    e.register("u", spark.range(2000).repartition(5))
    rows = e.sql("select $lineno as n, t.id as i, sum(t.id) as s from t t, u u where t.id = u.id").collect()
    total = 0
    for k, r in enumerate(sorted(rows, key=lambda r: r.n)):
        total += r.i
        assert (r.n, r.s) == (k + 1, total)


def test_tolerant_join_against_all_pairs(spark):
    r = random.Random(2)
    base = [r.uniform(-1, 1) * 10 ** r.randint(-8, 8) for _ in range(60)] + [0.0, 1e9, 1e9 + 1]
    left = base + [None]
    right = [x * (1 + r.uniform(-3e-9, 3e-9)) for x in base] + [0.0, None]
    same = lambda a, b: a == b or abs(a - b) < 1e-9 * (abs(a) + abs(b))
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a is not None and b is not None and same(a, b))
    a = spark.createDataFrame(list(enumerate(left)), "i int, x double")
    b = spark.createDataFrame(list(enumerate(right)), "j int, y double")
    out = tolerant_join(a, b, "x", "y")
    assert sorted((r.i, r.j) for r in out.collect()) == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_running_over_several_segments(spark):
    e = Engine(spark, order_by="k")
    values = [(k, None if k % 7 == 0 else float(k * k % 13)) for k in range(200)]
    e.register("t", spark.createDataFrame(values, "k int, v double").repartition(5))
    got = {r.k: r for r in e.sql("select k, count(v) as n, sum(v) as s, min(v) as lo, stdev(v) as d, count() as line from t x").collect()}
    import statistics

    for k in range(200):
        seen = [v for _, v in values[: k + 1] if v is not None]
        assert (got[k].n, got[k].s, got[k].lo, got[k].line) == (len(seen), sum(seen), min(seen, default=0), k + 1)
        assert got[k].d is None if len(seen) < 2 else got[k].d == pytest.approx(statistics.stdev(seen), abs=1e-6)


def test_paths(spark):
    row = spark.createDataFrame([("<a><foo><x><bar>fum</bar></x></foo><bar>NOT</bar></a>", '{foo: {"q": [{"bar": "FUM"}]}, "bar": 1}')], "x string, j string")
    got = row.select(xml_values(row.x, "/foo/bar"), json_values(row.j, "foo.bar")).first()
    assert (got[0], got[1]) == (["fum"], ["FUM"])


def test_pipeline_words(spark):
    assert [r.value for r in pipeline(spark, "1 to 10 sqr lt 55").collect()] == [1, 4, 9, 16, 25, 36, 49]
    assert pipeline(spark, "2 * 3 + 4").first().value == 10
    with pytest.raises(SqlError):
        pipeline(spark, "1 nonsense")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k int, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, v double").parquet(f"{tmp_path}/in")
    q = aggregated(stream, [("n", "count", None), ("s", "sum", "v")], ["k"]).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("sums").collect()} == {(k, 10.0, sum(float(i) for i in range(k, 30, 3))) for k in range(3)}


def test_pushed_filters(spark, tmp_path):
    spark.createDataFrame([(i, float(i)) for i in range(10)], "a int, x double").write.parquet(f"{tmp_path}/t.parquet")
    e = Engine(spark, folder=str(tmp_path))
    plan = e.sql("select a from t q where x = 3.5 and a < 5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x" in plan
    assert "LessThan(a,5)" in e.sql("select a from t q where a < 5")._jdf.queryExecution().executedPlan().toString()


def test_quoted_fields(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"a",b,\'c, d\',n\n"he said ""hi"", ok",1,\'it\'\'s\',"99"\n  x \\, y,\\N,"",3\n"back\\"slash",NULL,\'NULL\', 4 \n\n3m,5,z,\n')
    e = Engine(spark, folder=str(tmp_path))
    df = e.sql("select * from q f")
    assert df.columns == ["a", "b", "c, d", "n"]
    assert [tuple(r) for r in df.collect()] == [('he said "hi", ok', 1.0, "it's", 99.0), ("x , y", None, "", 3.0), ('back"slash', None, "NULL", 4.0), ("3m", 5.0, "z", None)]
    # Ends of lines inside quotes, and a backslash before one.
    (tmp_path / "nl.csv").write_text('a,b\n"one\ntwo",1\n\'three\n\nfour\',2\n"a ""q"" b",3\nfive \\\nsix,4\n')
    assert [tuple(r) for r in e.sql("select a, b from nl f").collect()] == [("one\ntwo", 1.0), ("three\n\nfour", 2.0), ('a "q" b', 3.0), ("five six", 4.0)]
    odd = spark.createDataFrame([(1, 'a"b', None), (2, "x,y\\z", "NULL"), (3, " 'lead", ""), (4, "plain", "two\nlines")], "k int, s string, t string")
    e.register("odd", odd)
    assert [r[0] for r in e.sql("format csv select k, s from odd o where k = 1").collect()] == ['1,"a""b"'] and e.sql("format bar select k, s from odd o").columns == ["k|s"]
    e.sql("format csv select k, s, t from odd o").coalesce(1).write.text(f"{tmp_path}/again")
    assert [tuple(r) for r in e.sql(f'select k, s, t from "{tmp_path}/again"(k,s,t) x order by k').collect()] == [(float(k), s, t) for k, s, t in odd.collect()]
    with pytest.raises(SqlError):
        e.sql("format nothing select 1")


def test_grouping_hides_other_columns(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 2), (3, 2)], "a int, b int"))
    assert one(e, "select b, sum(a) as s from t q group by b") == (2, 4.0)
    for bad in ("select a, b, count() from t q group by b", "select b from t q group by b having q.a > 1"):
        with pytest.raises(SqlError):
            e.sql(bad)
    with pytest.raises(SqlError):
        Engine(spark, order_by="nope").sql("select sum(1) from int(1,3) i")


def test_joins_follow_the_equalities(spark):
    e = Engine(spark)
    r = random.Random(3)
    rows = [(r.randrange(8), float(r.randrange(5))) for _ in range(40)]
    for t in "qru":
        e.register(t, spark.createDataFrame(rows, "a int, c double"))
    out = e.sql("select q.a as x, r.a as y, u.c as z from q q, r r, u u where q.c = u.c and r.a = u.a")
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert sorted(map(tuple, out.collect())) == sorted((q[0], x[0], u[1]) for q in rows for x in rows for u in rows if q[1] == u[1] and x[0] == u[0])


def test_running_ordered_by_text(spark):
    e = Engine(spark, order_by="k")
    values = [(f"key{r:04d}é", float(r)) for r in range(300)]
    e.register("t", spark.createDataFrame(values, "k string, v double").repartition(7))
    got = {r.k: r.s for r in e.sql("select k, sum(v) as s from t x").collect()}
    assert got == {k: sum(range(i + 1)) for i, (k, _) in enumerate(values)}


def test_functions_by_byte_and_seed(spark):
    e = Engine(spark)
    assert one(e, "select ascii('é'), ascii('A'), ascii('')") == (195.0, 65.0, 0.0)
    assert one(e, "select random(1)") == one(e, "select random(1)") != one(e, "select random(2)")
    assert one(e, "select srandom(5)") == (5.0,) and one(e, "select random()") == one(e, "select random(5)")
    assert one(e, "select xmlpath('<a><x><b>1</b></x><b>2</b></a>', '/a/b'), xmlpath('<a/>', 'b'), jsonpath('{a: {\"q\": [{\"b\": 7}]}, \"b\": 1}', 'a.b')") == ("1,2", None, "7")


@pytest.mark.parametrize("test", ["a.v < b.v", "b.v > a.v", "a.v >= b.v", "b.v <= a.v and a.v <> b.v"])
def test_a_join_of_few_keys_is_dealt_out(spark, monkeypatch, test):
    """One key has most rows, and some are null: its pairs go to many tasks, each once."""
    monkeypatch.setattr(joins, "MANY_PAIRS", 1)
    monkeypatch.setattr(joins, "TASK_PAIRS", 3000)
    rows = [(1 if i % 10 else None if i % 20 else 2, None if i % 41 == 7 else i * 37 % 200) for i in range(300)]
    e = Engine(spark)
    e.register("t", spark.createDataFrame(rows, "k int, v bigint"))
    df = e.sql(f"select a.v as x, b.v as y from t a, t b where a.k = b.k and {test}")
    holds = {"a.v < b.v": lambda x, y: x < y, "b.v > a.v": lambda x, y: x < y, "a.v >= b.v": lambda x, y: x >= y}.get(test, lambda x, y: x > y)
    want = sorted((v, w) for k, v in rows for m, w in rows if k is not None and k == m and v is not None and w is not None and holds(v, w))
    parts = [len(p) for p in df.rdd.glom().collect()]
    assert sorted(tuple(r) for r in df.collect()) == want and sum(parts) == len(want)
    assert max(parts) < 0.4 * len(want) and sum(n > 0 for n in parts) > 4
