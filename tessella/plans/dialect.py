"""A small query language over tables, translated to DataFrame plans.

Statements: ``SELECT``, ``INSERT INTO``, ``UPDATE`` and ``DELETE FROM``, with clauses in any order after the
table. Expressions have one precedence for all binary operators and group from the right: ``3 * 2 + 1``
is ``3 * (2 + 1)``. ``WHERE`` takes a comma list whose terms are applied one after the other; an
aggregate inside a term sees the rows left so far. ``GROUP BY`` in an update computes per group and
writes back to each row. ``ORDER BY`` and ``LIMIT`` are extensions.

The text is only parsed, never evaluated as code; names resolve to columns first, then to the values
given as variables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import aggregates as A
from tessella.functions import compare as C
from tessella.functions import maths as M
from tessella.functions import text, times, values
from tessella.functions import windows as N
from tessella.operators import tables
from tessella.operators.moving import running_sum, windowed
from tessella.operators.ranges import largest_group
from tessella.schema import uncollide

TOKEN = re.compile(r"""\s*(?:
    (?P<stamp>\d{4}[.-]\d\d[.-]\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)?)
  | (?P<rel>(?:\d+[ymdhis])+(?![A-Za-z0-9_]))
  | (?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)
  | (?P<op>\*\*|==|!=|<>|<=|>=|[-+*/%=<>~|&(),\[\]{}:;!])
)""", re.X)
CLAUSES = {"select", "from", "where", "group", "by", "order", "limit", "set", "values", "into", "on", "conflict", "update", "delete", "insert", "as"}

BINARY = {
    "+": M.plus, "-": M.minus, "*": M.times, "/": M.divide, "%": M.mod, "**": M.power, "=": C.equals, "==": C.equals, "!=": C.noteq, "<>": C.noteq,
    "<": C.less, ">": C.greater, "<=": C.lesseq, ">=": C.greatereq, "|": C.or_, "&": C.and_, "~": C.match,
    "and": lambda a, b: a.cast("boolean") & b.cast("boolean"), "or": lambda a, b: a.cast("boolean") | b.cast("boolean"), "mod": M.mod,
}
#: Aggregates by name, as functions of the value and the row order.
AGGREGATES = {
    "count": lambda x, o: A.count(), "len": lambda x, o: A.count(), "sum": lambda x, o: A.sum_(x), "avg": lambda x, o: A.avg(x), "min": lambda x, o: A.min_(x), "max": lambda x, o: A.max_(x), "std": lambda x, o: A.std(x), "var": lambda x, o: A.var(x),
    "median": lambda x, o: A.median(x), "first": lambda x, o: A.first(x, o), "last": lambda x, o: A.last(x, o), "count_null": lambda x, o: A.count_null(x), "count_nonnull": lambda x, o: A.count_nonnull(x),
}
#: Moving functions by name: a function of their arguments and a window, and how far they look (negative: ahead).
MOVING = {
    "msum": (lambda a, w: N.msum(_whole(a[0]), a[1].column, w), lambda a: _whole(a[0]) - 1), "mavg": (lambda a, w: N.mavg(_whole(a[0]), a[1].column, w), lambda a: _whole(a[0]) - 1),
    "mmax": (lambda a, w: N.mmax(_whole(a[0]), a[1].column, w), lambda a: _whole(a[0]) - 1), "mmin": (lambda a, w: N.mmin(_whole(a[0]), a[1].column, w), lambda a: _whole(a[0]) - 1),
    "mcount": (lambda a, w: N.mcount(_whole(a[0]), a[1].column, w), lambda a: _whole(a[0]) - 1), "shift": (lambda a, w: N.shift(_whole(a[0]), a[1].column, w, a[2].plain if len(a) > 2 else None), lambda a: _whole(a[0])),
    "deltas": (lambda a, w: N.mapback(M.minus, a[0].column, w), lambda a: 1), "rsum": (lambda a, w: N.rsum(a[0].column, w), lambda a: None),
}
#: Rows of a group up to which it is one task's work.
MOST = 2_000_000
SCALARS = {
    "abs": M.absolute, "sqrt": M.sqrt, "exp": M.exp, "pow": M.power, "ln": M.ln, "log": M.log, "lg": M.lg, "floor": M.floor, "ceil": M.ceil, "sin": M.sin, "cos": M.cos, "tan": M.tan, "asin": M.asin, "acos": M.acos, "atan": M.atan, "sinh": M.sinh, "cosh": M.cosh, "tanh": M.tanh, "erf": M.erf, "erfc": M.erfc,
    "negate": M.negate, "not": C.not_, "mins": C.mins, "maxes": C.maxes, "between": lambda x, lo, hi: C.between(x, lo, hi), "tolower": text.tolower, "toupper": text.toupper, "trim": text.trim, "string": text.string, "float": text.float_, "int": text.int_, "parse_int": text.parse_int, "parse_float": text.parse_float,
    "isnull": values.isnull, "ifnull": values.ifnull, "checksum": text.checksum, "stamp": times.stamp, "stamp_diff": times.stamp_diff, "now": times.now, "now_date": times.now_date, "now_time": times.now_time, "plus": M.plus, "minus": M.minus, "times": M.times, "divide": M.divide, "equals": C.equals, "less": C.less, "greater": C.greater,
}
TEXTS = {"tolower", "toupper", "trim", "string", "parse_int", "parse_float", "isnull", "ifnull", "checksum"}
FIELDS = {"year", "month", "day", "hour", "minute", "second", "week", "date", "time", "millisecond", "microsecond", "nanosecond"}


class DialectError(ValueError):
    """The text is not a statement of the language, or names something unknown."""


@dataclass
class Value:
    """A translated expression: its column, its plain value if it is a literal, the name it takes, the
    aggregates in it and whether it reads plain columns outside them."""

    column: Column | None
    plain: object = None
    name: str = ""
    relative: times.Relative | None = None
    aggregates: list[tuple[str, Column]] = field(default_factory=list)
    bare: bool = False
    many: list[Value] | None = None
    depth: int = 0
    nested: tuple[str, str] | None = None  #: column and path of a key of a schemaless record

    def typed(self, kind: str) -> Column:
        """The column, a key of a schemaless record as ``kind``: whoever uses it knows the type it needs."""
        return F.try_variant_get(F.col(self.nested[0]), self.nested[1], kind) if self.nested else self.column


def _whole(v: Value) -> int:
    if not isinstance(v.plain, int):
        raise DialectError("a window's length must be a whole number")
    return v.plain


class Steps:
    """Columns that an expression needs of whole groups, or of the table: aggregates repeated on each row, and
    moving functions, by how deep they stand in each other. ``add`` gives the column that ``apply`` makes.

    Aggregates are taken by group and joined back; moving functions run over windows of the group, or
    over ranges, if there is no group or one has more than ``MOST`` rows."""

    def __init__(self, keys: list[str], order: list[str]):
        self.keys, self.order, self.moving, self.aggregates = keys, order, {}, {}
        self.tag = f"_s{next(_TAGS)}_"

    def aggregate(self, c: Column) -> Column:
        name = f"{self.tag}a{len(self.aggregates)}"
        self.aggregates[name] = c
        return F.col(name)

    def add(self, depth: int, function: Callable, look: int | None, value: Column) -> Column:
        level = self.moving.setdefault(depth, {})
        name = f"{self.tag}m{depth}_{len(level)}"
        level[name] = function, look, value
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.aggregates:
            g = df.groupBy(*[F.col(k).alias(f"{self.tag}k{i}") for i, k in enumerate(self.keys)]).agg(*[c.alias(n) for n, c in self.aggregates.items()])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{self.tag}k{i}")) for i, k in enumerate(self.keys)])
            df = df.join(g, same, "left").drop(*[f"{self.tag}k{i}" for i in range(len(self.keys))])
        if self.moving:
            small = bool(self.keys) and largest_group(df, self.keys) <= MOST
        for _, level in sorted(self.moving.items()):
            if small:
                w = W.partitionBy(*self.keys).orderBy(*self.order)
                df = df.withColumns({n: f(w) for n, (f, _, _) in level.items()})
                continue
            near = {n: x for n, x in level.items() if x[1] is not None}
            if near:
                looks = [look for _, look, _ in near.values()]
                df = windowed(df, self.order, self.keys, {n: f for n, (f, _, _) in near.items()}, max(0, *looks, 0), max(0, *[-x for x in looks], 0))
            for n, (_, look, value) in level.items():
                if look is None:
                    df = running_sum(df.withColumn(f"{n}v", value), f"{n}v", self.order, self.keys, n).drop(f"{n}v")
        return df


_TAGS = count()


class Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip().rstrip(";")
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m or m.end() == at:
                if not source[at:].strip():
                    break
                raise DialectError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def word(self, ahead: int = 0) -> str:
        """The next token in lower case, if it is a name or sign."""
        i = self.at + ahead
        return self.tokens[i][1].lower() if i < len(self.tokens) and self.tokens[i][0] in ("name", "op") else ""

    def more(self) -> bool:
        return self.at < len(self.tokens)

    def take(self, want: str | None = None) -> str:
        if not self.more() or (want is not None and self.word() != want):
            raise DialectError(f"expected {want or 'more'} {'at the end' if not self.more() else 'before ' + repr(self.tokens[self.at][1])}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, want: str) -> bool:
        if self.word() == want:
            self.at += 1
            return True
        return False

    # expressions, as trees: (kind, ...)

    def expression(self) -> tuple:
        left = self.operand()
        w = self.word()
        if w in BINARY:
            self.take()
            return ("binary", w, left, self.expression())
        if w == "in":
            self.take()
            return ("in", left, self.operand())
        return left

    def operand(self) -> tuple:
        kind, value = self.tokens[self.at] if self.more() else ("", "")
        if kind in ("num", "str", "stamp", "rel"):
            self.take()
            node: tuple = (kind, value)
        elif value == "(":
            self.take()
            if self.word() == "select":
                node = ("select", self.select())
            else:
                node = self.expression()
            self.take(")")
        elif value == "[":
            self.take()
            items = []
            while self.word() != "]":
                items.append(self.expression())
                if not self.accept(","):
                    break
            self.take("]")
            node = ("list", items)
        elif value in ("-", "!"):
            self.take()
            return ("unary", value, self.operand())
        elif value == "*":
            self.take()
            node = ("star",)
        elif kind == "name" and value.lower() not in CLAUSES:
            self.take()
            if self.accept("("):
                args = []
                while self.word() != ")":
                    args.append(self.expression())
                    if not self.accept(","):
                        break
                self.take(")")
                node = ("call", value, args)
            elif value.lower() in AGGREGATES and self.starts_operand():
                node = ("call", value, [self.expression()])  # a function applied without parentheses
            else:
                node = ("name", value)
        else:
            raise DialectError(f"expected an expression before {value!r}" if value else "expected an expression at the end")
        while self.word() == "[":
            self.take()
            node = ("index", node, self.expression())
            self.take("]")
        return node

    def starts_operand(self) -> bool:
        if not self.more():
            return False
        kind, value = self.tokens[self.at]
        return kind in ("num", "str", "stamp") or (kind == "name" and value.lower() not in CLAUSES and value.lower() not in BINARY and value.lower() != "in")

    def named_list(self) -> list[tuple[tuple, str | None]]:
        out = []
        while True:
            e = self.expression()
            name = self.take() if self.accept("as") else None
            out.append((e, name))
            if not self.accept(","):
                return out

    def list_of(self) -> list[tuple]:
        return [e for e, _ in self.named_list()]

    # statements

    def table(self) -> tuple:
        if self.accept("("):
            inner = ("select", self.select()) if self.word() == "select" else self.table() if self.word() == "{" else ("table", self.take())
            self.take(")")
            return inner
        return self.literal() if self.word() == "{" else ("table", self.take())

    def literal(self) -> tuple:
        """``{{a: 1 2, b: [3, 4], c}}``, a table; ``{a: 1, b: 2}``, a map; ``{[{...}, {...}]}``, an atlas."""
        self.take("{")
        if self.accept("["):
            rows = [self.literal()]
            while self.accept(","):
                rows.append(self.literal())
            self.take("]")
            self.take("}")
            return ("atlas", [r[1] for r in rows])
        whole = self.accept("{")
        cells: list[tuple[str, list]] = []
        while self.word() != "}":
            name = self.take()
            name = name[1:-1] if name[0] in "'\"" else name
            values = []
            if self.accept(":"):
                values.append(self.expression())
                while self.more() and self.tokens[self.at][0] in ("num", "str", "stamp"):  # a list written without commas
                    values.append(self.expression())
            cells.append((name, values))
            if not self.accept(","):
                break
        self.take("}")
        if whole:
            self.take("}")
        return ("literal" if whole else "map", cells)

    def clauses(self, out: dict, allowed: set[str]) -> dict:
        while self.more() and self.word() != ")":
            w = self.word()
            if w not in allowed or w in out:
                raise DialectError(f"unexpected {self.tokens[self.at][1]!r}")
            self.take()
            if w in ("group", "order"):
                self.take("by")
            if w == "set":
                out[w] = self.sets()
            elif w == "order":
                out[w] = [self.ordered()]
                while self.accept(","):
                    out[w].append(self.ordered())
            else:
                out[w] = self.named_list() if w == "group" else self.expression() if w == "limit" else self.list_of()
        return out

    def ordered(self) -> tuple:
        e = self.expression()
        down = self.accept("desc")
        if not down:
            self.accept("asc")
        return e, down

    def sets(self) -> list[tuple[str, tuple]]:
        out = []
        while True:
            name = self.take()
            if not (self.accept("=") or self.accept(":")):
                raise DialectError(f"expected = after {name!r}")
            out.append((name, self.expression()))
            if not self.accept(","):
                return out

    def select(self) -> dict:
        self.take("select")
        out: dict = {}
        if self.word() == "distinct":
            self.take()
            out["distinct"] = True
        out["columns"] = self.named_list()
        self.take("from")
        out["table"] = self.table()
        return self.clauses(out, {"where", "group", "order", "limit"})

    def statement(self) -> tuple[str, dict]:
        w = self.word()
        if w == "select":
            out = ("select", self.select())
        elif w == "update":
            self.take()
            out = ("update", self.clauses({"table": self.table()}, {"set", "where", "group"}))
        elif w == "delete":
            self.take()
            self.take("from")
            out = ("delete", self.clauses({"table": self.table()}, {"where"}))
        elif w == "insert":
            out = ("insert", self.insert())
        elif w == "{":
            out = ("literal", {"tree": self.literal()})
        elif self.more() and self.tokens[self.at][0] == "name" and self.word(1) == "[":
            name = self.take()
            self.take("[")
            listed = self.accept("[")
            keys = self.list_of()
            if listed:
                self.take("]")
            self.take("]")
            out = ("index", {"name": name, "keys": keys, "listed": listed})
        else:
            raise DialectError("expected select, insert, update or delete")
        if self.more():
            raise DialectError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def insert(self) -> dict:
        self.take("insert")
        self.take("into")
        out: dict = {"table": self.table(), "columns": None, "conflict": None}
        if self.accept("("):
            out["columns"] = [self.take()]
            while self.accept(","):
                out["columns"].append(self.take())
            self.take(")")
        if self.word() == "select":
            out["select"] = self.select()
        else:
            self.take("values")
            if self.word() == "{":
                out["literal"] = self.literal()
            elif self.word() == "(":
                out["rows"] = []
                while True:
                    self.take("(")
                    out["rows"].append(self.list_of())
                    self.take(")")
                    if not self.accept(","):
                        break
            else:
                out["source"] = self.take()
        if self.accept("on"):
            self.take("conflict")
            self.take("(")
            out["conflict"] = [self.take()]
            while self.accept(","):
                out["conflict"].append(self.take())
            self.take(")")
            self.take("update")
        return out


class Engine:
    """Named tables and the statements over them. Changes give the table a new plan under its name; they
    are not written anywhere until the table is stored.

    ``order`` names, for each table, the columns of a total order, which ``first``, ``last`` and moving
    functions need; a table without one refuses them. A statement on ``(table)`` in parentheses returns
    the changed table without renaming it. ``functions`` are user functions of columns, such as
    ``functions.udf.vector`` makes, by the name they have in statements."""

    def __init__(self, spark: SparkSession, order: Mapping[str, list[str]] | None = None, variables: Mapping[str, object] | None = None, functions: Mapping[str, Callable[..., Column]] | None = None):
        self.spark, self.tables, self.order, self.variables = spark, {}, dict(order or {}), dict(variables or {})
        self.functions = {k.lower(): f for k, f in (functions or {}).items()}

    def add(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        self.tables[name] = df
        if order:
            self.order[name] = order

    def run(self, source: str) -> DataFrame:
        """One statement; the result, for a change the changed table."""
        p = Parser(source)
        kind, q = p.statement()
        if kind == "select":
            return self.select(q)
        if kind == "index":
            return self.indexed(**q)
        if kind == "literal":
            return self.literal(q["tree"])
        out = getattr(self, kind)(q)
        opened = re.match(r"\s*(update|delete\s+from|insert\s+into)\s*\(", source, re.I)
        if q["table"][0] == "table" and not opened:
            self.tables[q["table"][1]] = out
        return out

    def source(self, t: tuple) -> tuple[DataFrame, list[str]]:
        if t[0] == "select":
            return self.select(t[1]), []
        if t[0] == "plan":
            return t[1], t[2]
        if t[0] in ("literal", "map", "atlas"):
            return self.literal(t), []
        if t[1] not in self.tables:
            raise DialectError(f"no table {t[1]!r}")
        return self.tables[t[1]], self.order.get(t[1], [])

    def literal(self, t: tuple) -> DataFrame:
        """The table of a literal: lists of one element are repeated, a column without values is empty. An
        atlas, or a map with a nested value, gives the union of its keys; missing ones are null."""
        rows = [dict(r) for r in (t[1] if t[0] == "atlas" else [t[1]])]
        names = list(dict.fromkeys(n for r in rows for n in r))
        tr, out = Translator(self, self.spark.range(1), []), []
        for r in rows:
            lists = {n: [x for v in r.get(n, []) for x in (tr(v).many or [tr(v)])] for n in names}
            height = max(map(len, lists.values()), default=0)
            if any(len(x) not in (0, 1, height) for x in lists.values()) or t[0] != "atlas" and any(not x for x in lists.values()) and height:
                raise DialectError("columns differ in length")
            cells = [F.array(*[v.column for v in (x * height if len(x) == 1 else x)]).alias(n) if x else F.lit(None).alias(n) for n, x in lists.items()]
            one = self.spark.range(1).select(*cells)
            if height:
                there = [n for n, x in lists.items() if x]
                one = one.select(F.posexplode(F.arrays_zip(*there)).alias("_at", "_x"), *[n for n in names if n not in there]).select(*[F.col(f"_x.{n}") if n in there else F.col(n) for n in names])
            else:
                one = one.limit(0)
            out.append(one)
        return reduce(lambda a, b: a.unionByName(b), out)

    def indexed(self, name: str, keys: list[tuple], listed: bool) -> DataFrame:
        """``t[[a, b]]`` gives columns, ``t[[0, 2]]`` rows, ``t['a']`` one column, ``t[2]`` one row; places need the table's order."""
        df, order = self.source(("table", name))
        if all(k[0] in ("name", "str") for k in keys):
            return df.select(*[k[1] if k[0] == "name" else k[1][1:-1] for k in keys])
        if not all(k[0] == "num" for k in keys):
            raise DialectError("an index is a list of columns or of places")
        if not order:
            raise DialectError("places need the table's order")
        return tables.rows_at(df, [int(k[1]) for k in keys], order)

    def where(self, df: DataFrame, terms: list[tuple], order: list[str]) -> DataFrame:
        for t in terms:
            v = Translator(self, df, order, scalar=True)(t)
            df = df.filter(truth(df, v.column))
        return df

    def mask(self, df: DataFrame, terms: list[tuple], order: list[str]) -> Column:
        """One condition for all terms; aggregates see the rows that met the earlier ones."""
        out, left = F.lit(True), df
        for t in terms:
            c = truth(left, Translator(self, left, order, scalar=True)(t).column)
            out, left = out & F.coalesce(c, F.lit(False)), left.filter(c)
        return out

    def select(self, q: dict) -> DataFrame:
        df, order = self.source(q["table"])
        df = self.where(df, q.get("where", []), order)
        if "group" in q:
            keys = [(Translator(self, df, order)(e), name) for e, name in q["group"]]
            tr = Translator(self, df, order)
            cols = [(tr(e), name) for e, name in q["columns"]]
            if any(v.bare for v, _ in cols):
                raise DialectError("a grouped select takes aggregates only; use update ... group by for values per row")
            names = uncollide([n or v.name for v, n in keys + cols])
            out = df.groupBy(*[v.typed("string").alias(f"_k{i}") for i, (v, _) in enumerate(keys)]).agg(*[v.column.alias(f"_a{i}") for i, (v, _) in enumerate(cols)])
            out = out.toDF(*names)
        else:
            tr = Translator(self, df, order, steps=Steps([], order) if order else None)
            flat: list[tuple[Value, str | None]] = []
            for e, name in q["columns"]:
                flat += [(tr(("name", c)), None) for c in df.columns] if e == ("star",) else [(tr(e), name)]
            names = uncollide([n or v.name for v, n in flat])
            if flat and all((v.aggregates or v.plain is not None) and not v.bare for v, _ in flat) and any(v.aggregates for v, _ in flat):
                out = df.agg(*[v.column.alias(n) for (v, _), n in zip(flat, names)])
            else:
                # aggregates next to plain columns are computed first and repeated on every row
                tr = Translator(self, df, order, scalar=True, steps=Steps([], order) if order else None)
                again = []
                for e, name in q["columns"]:
                    again += [tr(("name", c)) for c in df.columns] if e == ("star",) else [tr(e)]
                out = (tr.steps.apply(df) if tr.steps else df).select(*[v.column.alias(n) for v, n in zip(again, names)])
        if q.get("distinct"):
            out = out.distinct()
        if "order" in q:
            try:
                out = out.orderBy(*self.sorting(out, q["order"]))
            except DialectError:  # by columns that aren't selected
                if "group" in q or q.get("distinct"):
                    raise
                out = self.select({k: v for k, v in q.items() if k not in ("order", "limit", "where")} | {"table": ("plan", df.orderBy(*self.sorting(df, q["order"])), order)})
        if "limit" in q:
            out = out.limit(int(q["limit"][1]))
        return out

    def sorting(self, df: DataFrame, terms: list[tuple]) -> list[Column]:
        tr = Translator(self, df, [])
        return [tr(e).column.desc_nulls_last() if down else tr(e).column.asc_nulls_first() for e, down in terms]

    def update(self, q: dict) -> DataFrame:
        df, order = self.source(q["table"])
        cond = self.mask(df, q["where"], order) if "where" in q else None
        if cond is not None:
            df = df.withColumn("_hit", cond)
        keys = []
        for i, (e, _) in enumerate(q.get("group", [])):
            df = df.withColumn(f"_g{i}", Translator(self, df, order)(e).typed("string"))
            keys.append(f"_g{i}")
        for name, e in q["set"]:
            if cond is not None and name not in df.columns:
                raise DialectError(f"a restricted update can't add column {name!r}")
            part = ["_hit", *keys] if cond is not None else keys
            steps, kept = Steps(part, order), list(dict.fromkeys([*df.columns, name]))
            seen = df.filter("_hit") if cond is not None and not keys else df
            value = Translator(self, seen, order, scalar=not keys, grouped=bool(keys), steps=steps)(e).column
            df = steps.apply(df).withColumn(name, value if cond is None else F.when(F.col("_hit"), value).otherwise(F.col(name))).select(*kept)
        return df.drop("_hit", *keys)

    def delete(self, q: dict) -> DataFrame:
        df, order = self.source(q["table"])
        return tables.delete(df, self.mask(df, q["where"], order)) if "where" in q else df.limit(0)

    def insert(self, q: dict) -> DataFrame:
        df, order = self.source(q["table"])
        cols = q["columns"] or df.columns
        if "select" in q:
            new = self.select(q["select"])
        elif "source" in q:
            new = self.source(("table", q["source"]))[0]
        elif "literal" in q:
            new, kinds = self.literal(q["literal"]), dict(df.dtypes)
            unknown = set(new.columns) - set(kinds)
            if unknown:
                raise DialectError(f"no columns {sorted(unknown)}")
            new = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns])
        else:
            if any(len(r) != len(cols) for r in q["rows"]):
                raise DialectError(f"a row needs {len(cols)} values")
            tr = Translator(self, df.limit(0), [])
            kinds = dict(df.dtypes)
            rows = [self.spark.range(1).select(*[tr(e).column.cast(kinds.get(c, "string")).alias(c) for c, e in zip(cols, r)]) for r in q["rows"]]
            new = rows[0]
            for r in rows[1:]:
                new = new.unionByName(r)
        if q["columns"] and sorted(new.columns) != sorted(cols) and len(new.columns) == len(cols):
            new = new.toDF(*cols)
        if q["conflict"]:
            if "rows" in q:  # the last of several rows for a key counts
                numbered = [r.withColumn("_n", F.lit(i)) for i, r in enumerate(rows)]
                new = numbered[0]
                for r in numbered[1:]:
                    new = new.unionByName(r)
                return tables.upsert(df, new, q["conflict"], "_n", order[0] if order else None)
            if not order:
                raise DialectError("on conflict needs the table's order, or rows as values")
            return tables.upsert(df, new.select(*df.columns), q["conflict"], order[0], order[0])
        return tables.insert(df, new, list(cols) if q["columns"] else None)


def eval_(spark: SparkSession, text_: str, tables_: Mapping[str, DataFrame] | None = None, **variables):
    """The value of an expression, or the table of a statement, in the query language. The text can do no
    more than the language: it reads the tables and variables given."""
    e = Engine(spark, variables=variables)
    for name, df in (tables_ or {}).items():
        e.add(name, df)
    if re.match(r"\s*(select|insert|update|delete)\b", text_, re.I):
        return e.run(text_)
    p = Parser(text_)
    tree = p.expression()
    if p.more():
        raise DialectError(f"unexpected {p.tokens[p.at][1]!r}")
    row = spark.range(1)
    return row.select(Translator(e, row, [])(tree).column.alias("x")).first()[0]


def truth(df: DataFrame, c: Column) -> Column:
    """A condition: whole numbers count as true unless 0."""
    kind = df.limit(0).select(c.alias("c")).schema[0].dataType.typeName()
    return c if kind == "boolean" else c != 0


class Translator:
    """Expression trees to columns. Aggregates become aggregate columns (default), values of a group on each
    of its rows (``grouped``), or subqueries over the rows at hand (``scalar``)."""

    def __init__(self, engine: Engine, df: DataFrame, order: list[str], scalar: bool = False, grouped: bool = False, steps: Steps | None = None):
        self.engine, self.df, self.order, self.scalar, self.grouped, self.steps = engine, df, order, scalar, grouped, steps

    def __call__(self, e: tuple) -> Value:
        return getattr(self, "_" + e[0])(*e[1:])

    def _num(self, s: str) -> Value:
        n = float(s) if re.search(r"[.eE]", s) else int(s)
        return Value(F.lit(n), n, "col")

    def _str(self, s: str) -> Value:
        t = re.sub(r"\\(.)", r"\1", s[1:-1])
        return Value(F.lit(t), t, "col")

    def _stamp(self, s: str) -> Value:
        day, _, clock = s.partition("T")
        clock = clock + ":00" if clock.count(":") == 1 else clock or "00:00:00"
        iso = f"{day.replace('.', '-')} {clock}"
        return Value(F.lit(iso).cast("timestamp_ntz"), iso, "col")

    def _rel(self, s: str) -> Value:
        return Value(None, s, "col", relative=times.relative(s))

    def _list(self, items: list[tuple]) -> Value:
        return Value(None, None, "col", many=[self(i) for i in items])

    def _star(self) -> Value:
        return Value(F.lit(1), 1, "count")

    def _select(self, q: dict) -> Value:
        """A subselect: for ``in`` a list of values of any length; elsewhere one value."""
        out = self.engine.select(q)
        if len(out.columns) != 1:
            raise DialectError("a subselect in an expression has one column")
        return Value(None, out, out.columns[0])

    def _name(self, name: str) -> Value:
        if name in self.df.columns:
            return Value(F.col(f"`{name}`"), None, name, bare=True)
        head, _, rest = name.partition(".")
        kinds = dict(self.df.dtypes)
        if rest and head in kinds:
            if kinds[head] == "variant":
                return Value(F.try_variant_get(F.col(head), "$." + rest, "variant"), None, rest.replace(".", "_"), bare=True, nested=(head, "$." + rest))
            if rest in FIELDS and kinds[head].startswith("timestamp"):
                return Value(times.field(rest, head), None, head, bare=True)
            return Value(F.col(name), None, rest.replace(".", "_"), bare=True)
        if name.lower() in ("null", "nil"):
            return Value(F.lit(None), None, "col")
        if name.lower() in ("true", "false"):
            return Value(F.lit(name.lower() == "true"), name.lower() == "true", "col")
        if name in self.engine.variables:
            v = self.engine.variables[name]
            if isinstance(v, (list, tuple)):
                return Value(None, None, name, many=[Value(F.lit(x), x) for x in v])
            return Value(F.lit(v), v, name)
        raise DialectError(f"no column or variable {name!r}")

    def _unary(self, op: str, e: tuple) -> Value:
        v = self(e)
        f = M.negate if op == "-" else C.not_
        return Value(f(v.typed("double")), -v.plain if op == "-" and isinstance(v.plain, (int, float)) else None, v.name, aggregates=v.aggregates, bare=v.bare, depth=v.depth)

    def _index(self, e: tuple, i: tuple) -> Value:
        """A field of a stamp, ``t['year']``, or an element of a list."""
        v, key = self(e), self(i)
        if isinstance(key.plain, str):
            if key.plain not in FIELDS:
                raise DialectError(f"no field {key.plain!r}")
            return Value(times.field(key.plain, v.column), None, v.name, aggregates=v.aggregates, bare=v.bare, depth=v.depth)
        return Value(F.get(v.column, key.column.cast("int")), None, v.name, aggregates=v.aggregates, bare=v.bare, depth=v.depth)

    def one(self, v: Value) -> Value:
        """A subselect's single value, found when the statement runs; more than one row is an error then, and
        none gives null."""
        return Value(v.plain.scalar(), None, v.name) if isinstance(v.plain, DataFrame) else v

    def _binary(self, op: str, a: tuple, b: tuple) -> Value:
        x, y = self.one(self(a)), self.one(self(b))
        more = dict(aggregates=x.aggregates + y.aggregates, bare=x.bare or y.bare, depth=max(x.depth, y.depth))
        name = x.name if x.plain is None else y.name
        if y.relative or x.relative:
            if op in ("+", "-") and y.relative:
                return Value(times.shift_by(x.column, y.relative, 1 if op == "+" else -1), None, name, **more)
            if op == "+":
                return Value(times.shift_by(y.column, x.relative), None, name, **more)
            turn = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
            cmp = {"==": "=", "<>": "!="}.get(op, op)
            return Value(times.compare(x.column, cmp, y.relative) if y.relative else times.compare(y.column, turn.get(cmp, cmp), x.relative), None, name, **more)
        if x.many is not None or y.many is not None:
            raise DialectError(f"a list can't stand beside {op}")
        f = BINARY[op]
        if x.nested or y.nested:  # text beside text, else a number
            kind = "string" if any(self.kind(c) == "string" for c in (x, y)) or x.nested and y.nested and op in ("=", "==", "!=", "<>") else "double"
            x, y = (Value(c.typed(kind), None, c.name) if c.nested else c for c in (x, y))
            return Value(f(x.column, y.column, text=True) if kind == "string" and op in ("<", ">", "<=", ">=") else f(x.column, y.column), None, name, **more)
        if op in ("<", ">", "<=", ">=") and any(self.kind(c) == "string" for c in (x, y)):
            return Value(f(x.column, y.column, text=True), None, name, **more)
        return Value(f(x.column, y.column), None, name, **more)

    def kind(self, v: Value) -> str:
        if v.plain is not None:
            return "string" if isinstance(v.plain, str) and not re.match(r"\d{4}-\d\d-\d\d \d\d:", v.plain) else ""
        return dict(self.df.dtypes).get(v.name, "") if v.bare else ""

    def _in(self, a: tuple, b: tuple) -> Value:
        x, y = self(a), self(b)
        if isinstance(y.plain, DataFrame):
            # a subselect of any length: a semi join, with null equal to null
            some = y.plain.toDF("_in").alias("_some")  # the alias hides the subselect's own columns
            return Value(some.filter(F.col("_in").eqNullSafe(x.column.outer())).exists(), None, x.name, aggregates=x.aggregates, bare=x.bare, depth=x.depth)
        items = y.many if y.many is not None else [y]
        if x.nested:
            x = Value(x.typed("string" if any(isinstance(i.plain, str) for i in items) else "double"), None, x.name, bare=True)
        return Value(C.in_(x.column, [i.plain for i in items]), None, x.name, aggregates=x.aggregates, bare=x.bare, depth=x.depth)

    def _call(self, name: str, args: list[tuple]) -> Value:
        low = name.lower()
        got = [self.one(self(a)) for a in args]
        column = got[-1].name if got else "col"
        if low in AGGREGATES and len(got) == 1:
            if any(v.aggregates for v in got):
                raise DialectError("an aggregate of an aggregate needs a nested select")
            if low in ("first", "last") and not self.order:
                raise DialectError(f"{low} needs the table's order")
            c = AGGREGATES[low](got[0].typed("string" if low in ("count", "len", "count_null", "count_nonnull", "first", "last") else "double"), F.struct(*self.order) if self.order else None)
            if self.grouped:
                return Value(self.steps.aggregate(c), None, column)
            if self.scalar:
                return Value(self.df.agg(c).scalar(), None, column, aggregates=[(low, c)])
            return Value(c, None, column, aggregates=[(low, c)])
        bare, aggs = any(v.bare for v in got), [x for v in got for x in v.aggregates]
        if low in MOVING:
            if self.steps is None or not self.order:
                raise DialectError(f"{low} needs the table's order, and can't stand in a grouped select")
            f, look = MOVING[low]
            depth = 1 + max(v.depth for v in got)
            return Value(self.steps.add(depth, lambda w: f(got, w), look(got), got[0].column), None, column, bare=True, depth=depth)
        if low == "bars":
            if got[0].relative:
                origin = got[2].column if len(got) > 2 else self.df.agg(F.min_by(got[1].column, F.struct(*self.order))).scalar() if self.order else None
                if origin is None:
                    raise DialectError("bars of time need the table's order, or a reference")
                return Value(times.time_bars(got[0].relative, got[1].column, origin, first=len(got) < 3), None, column, bare=bare)
            return Value(times.bars(got[0].column, got[1].column), None, column, bare=bare)
        if low == "distinct" and len(got) == 1:
            raise DialectError("distinct stands alone, after select")
        if low not in SCALARS and low not in self.engine.functions:
            raise DialectError(f"no function {name!r}")
        if low in self.engine.functions:
            return Value(self.engine.functions[low](*[v.typed("double") for v in got]), None, column, aggregates=aggs, bare=bare, depth=max([v.depth for v in got], default=0))
        got = [Value(v.typed("string" if low in TEXTS else "double"), None, v.name) if v.nested else v for v in got]
        plain = [v.column if v.plain is None or low not in ("parse_int",) or i == 0 else v.plain for i, v in enumerate(got)]
        return Value(SCALARS[low](*plain), None, column, aggregates=aggs, bare=bare, depth=max([v.depth for v in got], default=0))
