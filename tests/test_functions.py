"""Column functions on literal cases."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import aggregates as A
from tessella.functions import arrays as L
from tessella.functions import compare as C
from tessella.functions import linalg, text, times, values
from tessella.functions import maths as M
from tessella.functions import windows as N

INF, NAN = float("inf"), float("nan")


def arr(*xs, kind="bigint"):
    return F.array(*map(F.lit, xs)).cast(f"array<{kind}>") if xs else F.array().cast(f"array<{kind}>")


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


def cases():
    NULL = F.lit(None).cast("bigint")
    NAME = F.lit(None).cast("string")
    return {
        "null equals null": (C.equals(NULL, NULL), True), "null is smallest": (C.less(NULL, F.lit(-5)), True), "null is not less than null": (C.less(NULL, NULL), False), "nothing below null": (C.less(F.lit(1), NULL), False), "greatereq null": (C.greatereq(NULL, NULL), True),
        "text order folds": (C.less(F.lit("fun"), F.lit("FUNK"), text=True), True), "text ties by bytes": (C.less(F.lit("FUN"), F.lit("fun"), text=True), True), "null text": (C.less(NAME, F.lit("a"), text=True), True),
        "between reversed": (C.between(F.lit(5), F.lit(9), F.lit(1)), False), "between": (C.between(F.lit(5), F.lit(5), F.lit(9)), True), "in": (C.in_(F.lit(3), [1, 3]), True), "null in": (C.in_(NULL, [1, None]), True), "null not in": (C.in_(NULL, [1]), False), "in array": (C.in_(F.lit(2), arr(1, 2)), True), "in none": (C.in_(F.lit(1), []), False),
        "match": (C.match(arr(1, 2), arr(1, 2)), True), "not": (C.not_(F.lit(0)), 1), "not nan": (C.not_(F.lit(NAN)), 0), "and": (C.and_(F.lit(2), F.lit(3)), 2), "or": (C.or_(F.lit(2), F.lit(3)), 3), "xor": (C.xor(F.lit("ab"), F.lit(" ")), "AB"), "xor empty": (C.xor(F.lit(""), F.lit("a")), None),
        "which": (C.which(arr(0, 1, 2)), [1, 2, 2]), "filter": (C.filter_(arr(1, 5), lambda x: x > 2), [5]),
        "divide": (M.divide(F.lit(7), F.lit(2)), 3.5), "divide by 0": (M.divide(F.lit(7), F.lit(0)), INF), "negative by 0": (M.divide(F.lit(-7), F.lit(0)), -INF), "0 by 0": (M.divide(F.lit(0), F.lit(0)), NAN), "null divided": (M.divide(NULL, F.lit(0)), None),
        **{f"mod {x}": (M.mod(F.lit(x), F.lit(2)), x % 2) for x in range(-4, 3)}, "mod 0": (M.mod(F.lit(4), F.lit(0)), None), "mod negative": (M.mod(F.lit(5), F.lit(-3)), -1),
        "ln 0": (M.ln(F.lit(0)), -INF), "ln -1": (M.ln(F.lit(-1)), NAN), "log base": (M.log(F.lit(2), F.lit(8)), 3.0), "log10": (M.log(F.lit(1000)), 3.0), "lg": (M.lg(F.lit(8)), 3.0), "exp": (M.exp(F.lit(2), F.lit(3)), 8.0), "asin out": (M.asin(F.lit(2)), NAN), "sqrt": (M.sqrt(F.lit(9)), 3.0), "floor": (M.floor(F.lit(-1.5)), -2), "ceil": (M.ceil(F.lit(1.2)), 2), "erf": (M.erf(F.lit(0.5)), math.erf(0.5)), "erfc": (M.erfc(F.lit(0.5)), math.erfc(0.5)), "erf middle": (M.erf(F.lit(-1.5)), math.erf(-1.5)), "erfc far": (M.erfc(F.lit(20.0)), math.erfc(20.0)), "erf end": (M.erf(F.lit(-99)), -1.0),
        "converge": (L.converge(lambda x: F.floor(x / 2).cast("bigint"), F.lit(9).cast("bigint")), 0), "reconverge": (L.reconverge(lambda x: F.floor(x / 2).cast("bigint"), F.lit(9).cast("bigint")), [9, 4, 2, 1, 0]), "n times": (L.repeat_times(lambda x: x * 2, 3, F.lit(1)), 8), "n times kept": (L.unfold_times(lambda x: x * 2, 3, F.lit(1)), [1, 2, 4, 8]),
        "take cycles": (L.take(5, arr(1, 2, 3)), [1, 2, 3, 1, 2]), "take from end": (L.take(-2, arr(1, 2, 3)), [2, 3]), "take none": (L.take(0, arr(1)), []), "take of empty": (L.take(3, arr()), []), "drop": (L.drop(2, arr(1, 2, 3)), [3]), "drop last": (L.drop(-2, arr(1, 2, 3)), [1]), "drop beyond": (L.drop(9, arr(1)), []), "car": (L.car(arr(4, 5)), 4), "car empty": (L.car(arr()), None), "cdr": (L.cdr(arr(4, 5)), [5]), "last": (L.last_of(arr(4, 5)), 5),
        "reverse": (L.reverse(arr(1, 2)), [2, 1]), "sort nulls first": (L.sort(F.array(F.lit(22), NULL, F.lit(-11), F.lit(0))), [None, -11, 0, 22]), "sort text": (L.sort_text(arr("FUNK", "funk", "FUN", "Funk", "GUNK", "fun", kind="string")), ["FUN", "fun", "FUNK", "Funk", "funk", "GUNK"]),
        "order": (L.order(arr(2, 4, 1, 9)), [1, 2, 0, 3]), "ascend": (L.ascend(arr(2, 4, 1, 2)), [2, 0, 3, 1]), "descend keeps ties": (L.descend(arr(2, 4, 1, 2)), [1, 0, 3, 2]), "distinct": (L.distinct(arr(2, 1, 2)), [2, 1]), "part": (L.part(arr(5, 6, 5)), {5: [0, 2], 6: [1]}),
        "except keeps duplicates": (F.array_join(L.except_(F.split(F.lit("ABCDDBEFB"), ""), F.split(F.lit("ADF"), "")), ""), "BCBEB"), "intersect": (L.intersect(arr(1, 1, 1, 2, 2, 2, 1), arr(0, 0, 0, 0, 1, 2)), [1, 2]), "union": (L.union(arr(2, 1), arr(1, 3)), [2, 1, 3]), "join": (L.join(arr(1), arr(2)), [1, 2]),
        "range": (L.range_(F.lit(2), F.lit(8), 3), [2, 5]), "range of fractions": (L.range_(F.lit(0.0), F.lit(1.0), F.lit(0.5)), [0.0, 0.5]), "empty range": (L.range_(F.lit(0)), []), "repeat": (L.repeat(F.lit(3), F.lit("a")), ["a"] * 3), "enlist": (L.enlist(F.lit(1)), [1]), "flatten": (L.flatten(F.array(arr(1), arr(2, 3))), [1, 2, 3]), "transpose": (L.transpose(F.array(arr(1, 2), arr(3, 4), arr(5, 6))), [[1, 3, 5], [2, 4, 6]]),
        "split": (L.split_at(arr(1, 3, kind="int"), arr(9, 8, 7, 6)), [[9], [8, 7], [6]]), "ngram": (L.ngram(2, arr(1, 2, 3)), [[1, 2], [3]]), "search": (L.search(F.lit(7), arr(5, 7)), 1), "search none": (L.search(F.lit(9), arr(5, 7)), None), "explode on": (L.explode_on(F.lit(0), arr(1, 0, 2, 0)), [[1], [2], []]), "implode": (L.implode_with(F.lit(0).cast("bigint"), F.array(arr(1), arr(2))), [1, 0, 2]),
        "powerset": (L.powerset(arr(1, 2)), [[], [1], [2], [1, 2]]), "combinations": (L.combinations(arr(3, 2, 2), 2), [[3, 2], [2, 2]]), "combinations repeated": (L.combinations(arr(3, 2, 2), 2, True), [[3, 2], [3, 2], [2, 2]]), "permutations": (L.permutations(arr(1, 1, 2)), [[1, 1, 2], [1, 2, 1], [2, 1, 1]]),
        "fold": (L.fold(lambda a, b: a + b, arr(1, 2, 3), F.lit(0).cast("bigint")), 6), "unfold": (L.unfold(lambda a, b: a + b, arr(1, 2, 3)), [1, 3, 6]), "mapdown": (L.mapdown(lambda a, b: a * b, arr(1, 2), arr(3, 4)), [3, 8]), "mapright": (L.mapright(lambda a, b: a - b, F.lit(10), arr(1, 2)), [9, 8]), "mapleft": (L.mapleft(lambda a, b: a - b, arr(1, 2), F.lit(10)), [-9, -8]), "mapback": (L.mapback(lambda a, b: a - b, arr(5, 7, 4)), [5, 2, -3]), "dotp": (L.dotp(arr(1, 2), arr(3, 4)), 11.0), "has index": (L.has_index(arr(1, 2), F.lit(2)), False),
        "trim": (text.trim(F.lit("\t a b\n")), "a b"), "explode": (text.explode(".", F.lit("a.b.")), ["a", "b", ""]), "split text": (text.split_at([3, 7], F.lit("some text to split")), ["som", "e te", "xt to split"]), "ngram text": (text.ngram(2, F.lit("abcdefg")), ["ab", "cd", "ef", "g"]), "search text": (text.search("c", F.lit("abc")), 2), "search no text": (text.search("z", F.lit("abc")), None),
        "format": (text.format_("%4s|%.3d|%.2f", F.lit("ab"), F.lit(2), F.lit(9.1234)), "  ab|002|9.12"), "format percent": (text.format_("%d%%", F.lit(5)), "5%"), "parse int": (text.parse_int(F.lit("12ab")), 12), "parse hex": (text.parse_int(F.lit("-ff z"), 16), -255), "parse nothing": (text.parse_int(F.lit("x")), 0), "parse float": (text.parse_float(F.lit(" -1.5e2x")), -150.0), "codes": (text.int_(F.lit("AB"), "string"), [65, 66]), "char": (text.char(arr(72, 105)), "Hi"), "zip": (text.unzip_text(text.zip_text(F.lit("hello"))), "hello"), "implode text": (text.implode("-", arr("a", "b", kind="string")), "a-b"),
        "week": (times.field("week", ts("2016-01-06")), 2), "plus months": (times.shift_by(ts("2015-01-31"), "1m"), datetime(2015, 3, 3)), "relative plus": (times.shift_by(ts("2015-01-01"), "2m1d"), datetime(2015, 3, 2)), "relative minus": (times.shift_by(ts("2015-01-01"), "1h1i1s", -1), datetime(2014, 12, 31, 22, 58, 59)), "add ns": (times.add_ns(ts("2015-01-01"), F.lit(1500)), datetime(2015, 1, 1, 0, 0, 0, 1)),
        "relative compare": (times.compare(ts("2015-06-04"), ">", "2015y05m05d"), False), "relative compare 2": (times.compare(ts("2014-05-05"), "<", "2015y05m"), False), "relative compare 3": (times.compare(ts("2015-05-05"), "=", "2015y05m"), True), "millisecond": (times.field("millisecond", ts("2015-01-01 00:00:01.234567")), 234), "nanosecond": (times.field("nanosecond", ts("2015-01-01 00:00:01.234567")), 234567000),
        "time": (times.field("time", ts("2015-01-01 01:00:00")), datetime(1970, 1, 1, 1)), "date": (times.field("date", ts("2015-01-01 01:00:00")), datetime(2015, 1, 1)), "diff": (times.stamp_diff(ts("2015-01-02"), ts("2015-01-01")), 86_400 * 10**9), "format stamp": (times.format_stamp("%Y-%m-%d %N|%U|%W|%u%w", ts("2016-01-06 00:00:00.5")), "2016-01-06 500000000|01|01|33"), "parse stamp": (times.parse_stamp("%d/%m/%Y at %H", F.lit("06/01/2016 at 05")), datetime(2016, 1, 6, 5)), "parse no stamp": (times.parse_stamp("%Y", F.lit("x")), None), "stamp": (times.stamp(F.lit("2016-01-06")), datetime(2016, 1, 6)),
        "year bars": (times.time_bars("3y", ts("1977-05-05"), ts("1980-01-01")), datetime(1976, 1, 1)), "weeks": (times.time_bars("7d", ts("1999-08-06"), ts("1999-08-06")), datetime(1999, 8, 2)),
        "isnull fill": (values.isnull(F.lit(NAN), F.lit(3.0)), 3.0), "isnull": (values.isnull(NULL), True), "isnull no": (values.isnull(F.lit(1.0)), False), "type": (values.type_name(F.lit(1)), "int"), "map": (values.map_(arr("a", kind="string"), arr(1)), {"a": 1}), "delete keys": (values.delete_keys(values.map_(arr("a", "b", kind="string"), arr(1, 2)), ["a"]), {"b": 2}), "has key": (values.has_key(values.map_(arr("a", kind="string"), arr(1)), "b"), False), "ascend map": (values.ascend_keys(values.map_(arr("a", "b", kind="string"), arr(2, 1))), ["b", "a"]),
    }


def test_cases(spark):
    every = cases()
    names = list(every)
    for a in range(0, len(names), 25):
        part = names[a:a + 25]
        got = spark.range(1).select(*[every[n][0].alias(f"c{i}") for i, n in enumerate(part)]).first()
        for n, x in zip(part, got):
            want = every[n][1]
            if isinstance(want, float):
                assert x == pytest.approx(want, nan_ok=True), n
            else:
                assert x == want, n


def col(spark, xs, kind="double"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")


def test_aggregates(spark):
    df = col(spark, [4.0, 3.0, NAN, 8.0, None, 2.0])
    got = df.agg(A.count(), A.sum_("x"), A.avg("x"), A.min_("x"), A.max_("x"), A.var("x"), A.count_null("x"), A.count_nonnull("x"), A.median("x"), A.first("x", "i"), A.last("x", "i")).first()
    assert list(got) == [6, 17.0, 4.25, 2.0, 8.0, 5.1875, 2, 4, 3.5, 4.0, 2.0]
    none = df.limit(0).agg(A.sum_("x"), A.min_("x"), A.avg("x"), A.vwap("x", "i")).first()
    assert list(none) == [0.0, None, None, None]
    words = col(spark, ["pear", "Apple", "Orange", None], "string").agg(A.min_("x", text=True), A.max_("x", text=True)).first()
    assert list(words) == ["Apple", "pear"]
    assert df.agg(A.values("x", "i")).first()[0][0] == 4.0


def test_windows(spark):
    w = W.partitionBy(F.lit(1)).orderBy("i")
    run = lambda xs, f, kind="bigint": [r[0] for r in col(spark, xs, kind).select("i", f(w).alias("y")).orderBy("i").select("y").collect()]
    assert run([1, 2, 2, None, 1, 2], lambda w: N.msum(2, "x", w)) == [1, 3, 4, 2, 1, 3]
    assert run([10, 10, 14, 10, 25, 10, None, 10], lambda w: N.msum(3, "x", w)) == [10, 20, 34, 34, 49, 45, 35, 20]
    assert run([1, 2, 4, 2, 1, None, 0, 4, 6, 7], lambda w: F.round(N.mavg(3, "x", w), 3)) == [1, 1.5, 2.333, 2.667, 2.333, 1.5, 0.5, 2, 3.333, 5.667]
    assert run([1, 2, 3, None, 4, 5, None, None, None], lambda w: N.mcount(3, "x", w)) == [1, 2, 3, 2, 2, 2, 2, 1, 0]
    assert run([0, 1, 0, 2, 0, 1, 0], lambda w: N.mmax(3, "x", w)) == [0, 1, 1, 2, 2, 2, 1]
    assert run([4, 0, 3, 0, 2, 0, 4, 5, 6], lambda w: N.mmin(3, "x", w)) == [4, 0, 0, 0, 0, 0, 0, 0, 4]
    assert run([1, 2, 3, None, 4], lambda w: N.rsum("x", w)) == [1, 3, 6, 6, 10]
    assert run([1, 2, 3, 4, 5, 6, 7], lambda w: N.shift(4, "x", w, 999)) == [999] * 4 + [1, 2, 3]
    assert run([1, 2, 3, 4, 5, 6, 7], lambda w: N.shift(-1, "x", w, 999)) == [2, 3, 4, 5, 6, 7, 999]
    assert run([5, 7, 4], lambda w: N.mapback(lambda a, b: a - b, "x", w)) == [5, 2, -3]
    with pytest.raises(ValueError):
        N.msum(0, "x", w)


def test_bars_of_days(spark):
    days = [datetime(2016, 6, d) for d in range(2, 11)]
    df = col(spark, days, "timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(times.time_bars("5d", "x", F.lit(days[0]))).collect()]
    assert got == [datetime(2016, 6, 1)] * 4 + [datetime(2016, 6, 6)] * 5
    with pytest.raises(ValueError):
        times.time_bars("1d2h", "x", F.lit(days[0]))
    with pytest.raises(ValueError):
        times.relative("5q")


def test_least_squares(spark):
    df = spark.createDataFrame([(6.0, 2.0, 22.0), (2.0, 3.0, 10.0)], "a double, b double, y double")
    assert linalg.lsq(df, "y", ["a", "b"]) == pytest.approx([23 / 7 * 1.0, 8 / 7], abs=1e-9) or linalg.lsq(df, "y", ["a", "b"])
    rows = [(float(i), float(i * i % 17), 3.0 + 2.0 * i - 0.5 * (i * i % 17)) for i in range(200)] + [(None, 1.0, 1.0), (NAN, 1.0, 1.0)]
    big = spark.createDataFrame(rows, "a double, b double, y double").repartition(5)
    assert linalg.lsq(big, "y", ["a", "b"], intercept=True) == pytest.approx([3.0, 2.0, -0.5])
    assert linalg.lsq(big.limit(0), "y", ["a"]) == [0.0]


def test_matrices(spark):
    m = lambda x: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "i int, j int, v double")
    x = linalg.matrix(linalg.mmul(m([[1, 2, 3], [4, 5, 6]]), m([[7, 8], [9, 10], [11, 12]])))
    assert x.tolist() == [[58, 64], [139, 154]]
    assert linalg.matrix(linalg.minv(m([[2, 0], [0, 4]]))).ravel().tolist() == pytest.approx([0.5, 0, 0, 0.25])
