"""Verbs around queries, user functions, and the driver's contract."""

import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella import session as S
from tessella import system
from tessella.functions import udf
from tests.conftest import rows

VERBS = """equals noteq less lesseq greater greatereq between in match not and or xor which filter plus add minus subtract times divide mod negate negative abs exp pow sqrt ln log lg floor ceil sin cos tan asin acos
atan sinh cosh tanh erf erfc mins maxes count len sum avg min max std var median first last count_null count_nonnull distinct unique part msum mcount mavg mmax mmin rsum shift maxback minback bucketed order sort ascend
descend reverse take drop car cdr shuffle sort_debug union intersect except setminus powerset left_join asof_join join cross tolower toupper trim explode implode split_at ngram search format parse_int parse_float from_json
to_json uneval rep string now now_date now_time stamp stamp_diff bars format_stamp parse_stamp timing sleep range enumerate repeat enlist flatten transpose atom map table xkeys xvals has_key delete_keys extract atlas meta_table
tables help reserved combinations permutations rand deal checksum dotp mmul minv lsq int float char isnull ifnull type_null type_name hashed enum index indexed btree key primary nonnull unique compressed zip unzip
open_socket close_socket send_async send_sync dlload system shell out display exit reset emu_debug_mode ident global fold unfold mapdown mapright mapleft mapback mapcores lines write_text dir_ls mkdir load run
read_table_from_csv read_table_from_tsv read_table_from_delimited_file create_table_from_csv append_table_from_psv read_table_from_fixed_file write_csv_from_table write_delimited_file_from_table read_from_path write_to_path
open_table read_striped_from_path write_striped_to_path read_parceled_from_path""".split()


def test_every_verb_is_found():
    for v in VERBS:
        assert callable(system.find(v)), v
    with pytest.raises(KeyError):
        system.find("nothing")
    where = {"eval": "plans.dialect", "has_column": "operators.tables", "load": "sources.store", "table": "operators.tables", "split": "functions.arrays", "some_type": "functions.values", "converge": "functions.arrays"}
    assert {v: system.find(v).__module__.removeprefix("tessella.") for v in where} == where
    assert "nulls" in system.help_("sort") and "select" in system.reserved()


def test_surroundings(spark, capsys):
    assert system.send_sync(spark, "select :x + 1 as y", x=2)[0].y == 3
    assert system.send_async(spark, "select 5 as y").result()[0].y == 5
    assert system.timing(lambda: 7)[0] == 7 and system.shell(["echo", "a;b"]) == ["a;b"] and system.system(["true"]) == 0
    df = spark.createDataFrame([(1, "x" * 40), (300, None)], "a long, s string")
    df.createOrReplaceTempView("seen")
    assert "seen" in system.tables(spark)
    system.reset(spark)
    assert "seen" not in system.tables(spark)
    assert [tuple(r) for r in system.compressed(df, a="INT1", s="STR32").orderBy("s").collect()] == [(None, None), (1, "x" * 32)]
    assert system.nonnull(df, "a").count() == 2
    with pytest.raises(Exception, match="null in s"):
        system.nonnull(df, "s").collect()
    assert system.unique(df, "a") is df
    with pytest.raises(ValueError):
        system.unique(df.union(df), "a")
    system.display(df)
    system.out("said")
    assert "said" in capsys.readouterr().out
    assert "Codegen" in system.debug(df.select(F.col("a") + 1)) and "ordering" in system.sort_debug(df)


def test_user_functions(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(9)], "k int, x double")
    double = udf.vector(lambda x: x * 2, "double")
    assert df.select(F.sum(double("x"))).first()[0] == 72
    spread = udf.aggregate(lambda x: float(x.max() - x.min()), "double")
    assert rows(df.groupBy("k").agg(spread("x").alias("s"))) == [(0, 6.0), (1, 6.0), (2, 6.0)]
    assert udf.table_function(df, ["k"], lambda p: pd.DataFrame({"n": [len(p)]}), "n long").agg(F.sum("n")).first()[0] == 9
    assert udf.parallel(df, lambda p: p[p.x > 5][["x"]], "x double").count() == 3
    assert rows(udf.fixpoint(df.select("k"), lambda d: d.select(F.greatest(F.col("k") - 1, F.lit(0)).alias("k"))).distinct()) == [(0,)]
    with pytest.raises(RuntimeError):
        udf.fixpoint(df.select("k"), lambda d: d.select((F.col("k") + 1).alias("k")), 2)


def test_durable_tables(spark):
    df = spark.range(5).withColumn("r", F.rand())
    d = S.durable(df)
    assert rows(d) == rows(d) and S.range_parts(df, 2) >= 3 and S.spread(spark.range(3).coalesce(1)).count() == 3
    assert S.checkpoint_dir(spark) == S.checkpoint_dir(spark)


def test_registered_queries(spark, sf):
    import __spark_entry__ as e

    known, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(known) and len(known) > 100
    assert e.entry(spark).count() > 0
    for n in (1, 2, 3, 5, 6):
        q = known[f"p{n}_found"](spark, sf)
        assert q.columns == {1: ["tab", "row_id"], 2: ["enumstring", "day"], 3: ["intcol", "field"], 5: ["enumstring", "first_hour", "last_hour"], 6: ["enumstring", "stamp_us"]}[n]
        assert q.count() > 0
    spark.catalog.clearCache()


def test_core_stands_without_llm():
    """No module outside the optional subpackage imports it."""
    root = Path(__file__).parent.parent
    for f in root.glob("tessella/**/*.py"):
        if "llm" not in f.parts:
            assert "import" not in "".join(line for line in f.read_text().splitlines() if "tessella.llm" in line)
    code = "import sys; sys.modules['tessella.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p9') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_text_is_evaluated_in_the_language_only(spark):
    from tessella.plans.dialect import DialectError, eval_

    assert eval_(spark, "3 * 2 + 1") == 9 and eval_(spark, "x - 1", x=3) == 2
    assert eval_(spark, "select max(id) as m from t", {"t": spark.range(5)}).first().m == 4
    with pytest.raises(DialectError):
        eval_(spark, "__import__('os')")


def test_kinds_and_marks(spark):
    from datetime import datetime

    from tessella.functions import text, times, values
    from tessella.schema import meta_table

    t = datetime(2021, 5, 6, 7, 8, 9, 123456)
    df = spark.createDataFrame([("a", 1, 2.5, t, [1], ["x"], {"k": 1})], "s string, i int, f double, t timestamp_ntz, l array<bigint>, m array<string>, d map<string,int>")
    assert list(df.select(*[values.type_code(c) for c in df.columns], values.type_code(F.lit(None)), values.type_code(F.lit(1).cast("decimal(9,2)"))).first()) == [-1, 2, 3, 4, -2, 6, 7, 5, 3]
    j = df.select(text.to_json(F.struct("t", "s"), "STAMP_").alias("j"))
    assert j.first().j == '{"t":"STAMP_2021-05-06T07:08:09.123456","s":"a"}'
    back = j.select(F.from_json("j", "t string, s string").alias("r")).select(text.stamp_of("r.t", "STAMP_"), text.stamp_of("r.s", "STAMP_")).first()
    assert list(back) == [t, None]
    assert [r[0] for r in spark.createDataFrame([(datetime(1970, 1, 1, 5),), (datetime(2021, 1, 1),), (t,), (None,)], "t timestamp_ntz").select(times.kind("t")).collect()] == ["time", "date", "datetime", None]
    m = {r.name: (r.sorted, r.on_disk) for r in meta_table(df.orderBy("i")).collect()}
    assert m["i"] == (True, False) and m["s"] == (False, False)


def test_log_and_replay_and_end_of_streams(spark, tmp_path):
    import time

    log = str(tmp_path / "log")
    assert system.logged(spark, log, "select :x + 1 as y", x=2)[0].y == 3 and system.logged(spark, log, "select 'a' as z")[0].z == "a"
    assert [r[0][0] for r in system.replay(spark, log)] == [3, "a"]
    ended = []
    hook = system.on_close(spark, ended.append)
    spark.range(1).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(100):
        if ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(hook)
    assert ended == [q.id]
