"""Session, process and storage verbs that surround queries, and a lookup of all verbs by name."""

from __future__ import annotations

import importlib
import json
import subprocess
import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_POOL = ThreadPoolExecutor(4)


# running things


def timing(f: Callable, *args) -> tuple[object, float]:
    """A call's result and its milliseconds."""
    t = time.perf_counter()
    out = f(*args)
    return out, (time.perf_counter() - t) * 1000


def sleep(ms: float) -> None:
    time.sleep(ms / 1000)


def send_sync(spark: SparkSession, statement: str, **args) -> list:
    """A SQL statement's rows; values stand as ``:name`` and are bound, not pasted."""
    return spark.sql(statement, args=args or None).collect()


def send_async(spark: SparkSession, statement: str, **args) -> Future:
    """The same without waiting."""
    return _POOL.submit(send_sync, spark, statement, **args)


def logged(spark: SparkSession, log: str, statement: str, **args) -> list:
    """``send_sync``, after the statement and its values are added to a log, a file of JSON lines."""
    with open(log, "a") as f:
        f.write(json.dumps({"statement": statement, "args": args}) + "\n")
    return send_sync(spark, statement, **args)


def replay(spark: SparkSession, log: str) -> list[list]:
    """The results of a log's statements, run again in their order."""
    with open(log) as f:
        return [send_sync(spark, x["statement"], **x["args"]) for x in map(json.loads, f)]


class _Ended(StreamingQueryListener):
    def __init__(self, f: Callable[[str], None]):
        self.f = f

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.f(str(event.id))


def on_close(spark: SparkSession, f: Callable[[str], None]) -> StreamingQueryListener:
    """Calls ``f`` with a stream's id when it ends; the listener can be removed from ``spark.streams`` again."""
    out = _Ended(f)
    spark.streams.addListener(out)
    return out


def connect(url: str) -> SparkSession:
    """A session on a remote Spark server (``sc://host:port``)."""
    return SparkSession.builder.remote(url).getOrCreate()


def close(spark: SparkSession) -> None:
    spark.stop()


exit_ = close


def reset(spark: SparkSession) -> None:
    """Drops cached data and temporary views."""
    spark.catalog.clearCache()
    for t in spark.catalog.listTables():
        if t.isTemporary:
            spark.catalog.dropTempView(t.name)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def shell(command: Sequence[str]) -> list[str]:
    """Lines a command prints on the driver. The command is a list of words; no shell reads it."""
    return subprocess.run(list(command), capture_output=True, text=True, check=True).stdout.splitlines()


def system(command: Sequence[str]) -> int:
    """A command's status."""
    return subprocess.run(list(command), check=False).returncode


def register_java(spark: SparkSession, name: str, class_name: str, kind: str | None = None) -> None:
    """A compiled function, under a name for SQL."""
    spark.udf.registerJavaFunction(name, class_name, kind)


# looking at things


def out(text: str) -> None:
    print(text)


def display(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def debug(df: DataFrame) -> str:
    """The physical plan with the generated code."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))


def sort_debug(df: DataFrame) -> dict[str, str]:
    """What the plan knows of order and partitioning."""
    p = df._jdf.queryExecution().executedPlan()
    return {"ordering": p.outputOrdering().mkString(", "), "partitioning": p.outputPartitioning().toString()}


# storage hints: files with dictionaries and bounds take the place of interned and indexed columns


def hashed(df: DataFrame, *_: str) -> DataFrame:
    """Interning is the file format's dictionary encoding: nothing to do."""
    return df


enum = hashed


def indexed(df: DataFrame, *cols: str) -> DataFrame:
    """Sorted within partitions, so that files written next have narrow bounds in these columns."""
    return df.sortWithinPartitions(*cols) if cols else df


index = btree = key = primary = indexed


def nonnull(df: DataFrame, *cols: str) -> DataFrame:
    """``df``, whose reading fails at a null in these columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)) for c in cols})


def unique(df: DataFrame, *cols: str) -> DataFrame:
    """``df``, after a check that no two rows agree in these columns."""
    if df.groupBy(*cols).count().filter("count > 1").limit(1).count():
        raise ValueError(f"rows agree in {cols}")
    return df


#: Narrow types by code; a value that doesn't fit is null.
NARROW = {"INT4": "int", "INT2": "smallint", "INT1": "tinyint", "FLOAT4": "float", "DEC4INT8": "decimal(18,4)", "STR32": "string"}


def compressed(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns in narrow types; files are compressed anyway."""
    return df.withColumns({c: F.substring(c, 1, 32) if k == "STR32" else F.col(c).try_cast(NARROW[k]) for c, k in kinds.items()})


# lookup

MODULES = ("functions.compare", "functions.maths", "functions.aggregates", "functions.windows", "functions.arrays", "functions.text", "functions.times", "functions.values", "functions.linalg", "functions.udf", "operators.tables", "operators.joins", "operators.ranges", "operators.atlas", "sources.delimited", "sources.store", "system", "schema", "plans.dialect")
#: Verbs whose function has another name than the verb itself (or the verb with an underscore).
OTHER = {
    "abs": "absolute", "pow": "power", "left_join": "left_join", "unite": "union", "match": "match", "part": "part", "explode": "explode", "json": "to_json", "type": "type_name", "null_type": "type_null", "until": "range_", "enumerate": "enumerate_",
    "read_table_from_csv": "read_csv", "read_table_from_tsv": "read_tsv", "read_table_from_delimited_file": "read_delimited", "read_table_from_fixed_file": "read_fixed", "create_table_from_csv": "create_table", "create_table_from_tsv": "create_table", "create_table_from_psv": "create_table",
    "append_table_from_csv": "append_table", "append_table_from_tsv": "append_table", "append_table_from_psv": "append_table", "create_table_from_fixed_file": "create_table_fixed", "append_table_from_fixed_file": "append_table_fixed", "write_csv_from_table": "write_delimited", "write_delimited_file_from_table": "write_delimited",
    "read_from_path": "read_table", "write_to_path": "write_table", "open_table": "read_table", "read_striped_from_path": "read_table", "write_striped_to_path": "write_table", "read_parceled_from_path": "read_table", "load": "run_script", "run": "run_script", "split": "split_at", 
    "count_rows": "count", "len": "count", "ifnull": "isnull", "xkeys": "keys", "xvals": "vals", "zip": "zip_text", "unzip": "unzip_text", "open_socket": "connect", "close_socket": "close", "dlload": "register_java", "emu_debug_mode": "debug", "seed_prng": "rand", "extract": "extract", "uneval": "to_json", "rep": "to_json",
    "reduce": "fold", "refold": "unfold", "rereduce": "unfold", "deconverge": "reconverge", "globals": "identity", "mapcores": "parallel", "ident": "identity", "global": "identity", "subtract": "minus", "add": "plus", "negative": "negate", "equal": "equals", 
}


def find(verb: str) -> Callable:
    """The function of a verb: by its name in the modules' order, else by another name it has here. Verbs of
    kinds (``..._type`` and ``..._type_name``) go by their endings."""
    verb = "type_code" if verb.endswith("_type") and verb != "null_type" else "type_name" if verb.endswith("_type_name") else verb
    for name in (verb, f"{verb}_", OTHER.get(verb, "")):
        for m in MODULES:
            f = getattr(importlib.import_module(f"tessella.{m}"), name, None) if name else None
            if callable(f):
                return f
    raise KeyError(f"no verb {verb!r}")


def help_(verb: str) -> str:
    """A verb's description."""
    return find(verb).__doc__ or f"{find(verb).__name__}: see {find(verb).__module__}"


def reserved() -> list[str]:
    """Words that can't be names in the query language."""
    from tessella.plans.dialect import BINARY, CLAUSES

    return sorted(CLAUSES | {b for b in BINARY if b.isalpha()} | {"in"})
