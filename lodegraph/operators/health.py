"""Index statistics and integrity checks, as plain aggregates and anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.graph import FOREIGN_KEYS, Graph

OPEN_TARGETS = ("contains", "declares", "defines", "diagnostic_for")


def index_stats(g: Graph) -> DataFrame:
    """(key, value): counts of the tables, of unresolved ends (an edge may count twice) and of files by language."""
    count = lambda df, key: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("key"), "n")
    parts = [count(getattr(g, t), f"{t}s") for t in ("file", "node", "edge", "occurrence", "chunk", "diagnostic")]
    ends = F.col("unresolved_src").isNotNull().cast("int") + F.col("unresolved_dst").isNotNull().cast("int")
    parts.append(g.edge.agg(F.coalesce(F.sum(ends), F.lit(0)).alias("n")).select(F.lit("unresolved_references").alias("key"), "n"))
    parts.append(g.file.groupBy(F.coalesce("language", F.lit("unknown")).alias("l")).count().select(F.concat(F.lit("language."), "l").alias("key"), F.col("count").alias("n")))
    return reduce(DataFrame.unionByName, parts).select("key", F.col("n").cast("string").alias("value"))


def edge_problems(edge: DataFrame) -> DataFrame:
    """(id, problem) of edges that lack an end they must have."""
    bad = (F.col("src_node_id").isNull() & F.col("unresolved_src").isNull()) | (F.col("dst_node_id").isNull() & F.col("unresolved_dst").isNull() & ~F.col("kind").isin(*OPEN_TARGETS))
    return edge.where(bad).select("id", F.concat(F.lit("edge "), F.col("id").cast("string"), F.lit(" has unresolved "), "kind", F.lit(" endpoint")).alias("problem"))


_SPAN_TABLES = ("node", "edge", "diagnostic", "occurrence", "chunk")


def span_problems(g: Graph) -> DataFrame:
    """(place, id, nth, problem) of spans that are reversed, negative, or beyond their file, in the order of the checks."""
    bounds = g.file.select(F.col("id").alias("__f"), F.col("line_count").alias("lines"), F.col("size_bytes").alias("size"))
    parts = []
    for place, name in enumerate(_SPAN_TABLES):
        t = getattr(g, name)
        null = F.lit(None).cast("long")
        col = lambda c, t=t, null=null: (F.col(c) if c in t.columns else null).cast("long").alias(c)
        parts.append(t.select(F.lit(place).alias("place"), F.lit(name).alias("t"), "id", "file_id", *map(col, ("start_byte", "end_byte", "start_line", "end_line"))))
    rows = reduce(DataFrame.unionByName, parts).join(bounds.hint("shuffle_hash"), F.col("file_id") == F.col("__f"), "left")  # a task holds its files, and sorts no spans
    sb, eb, sl, el = (F.col(c) for c in ("start_byte", "end_byte", "start_line", "end_line"))
    known, absent = F.col("__f").isNotNull(), F.col("file_id").isNotNull() & F.col("__f").isNull()
    checks = [
        (sb > eb, "has start_byte after end_byte"), (sb < 0, "has negative start_byte"), (eb < 0, "has negative end_byte"), (sl > el, "has start_line after end_line"), (sl < 1, "has non-positive start_line"),
        (el < 1, "has non-positive end_line"), (absent, "references a file outside the snapshot"), (known & (sb > F.col("size")), "start_byte exceeds file size"), (known & (eb > F.col("size")), "end_byte exceeds file size"),
        (known & (sl > F.col("lines")), "start_line exceeds file line count"), (known & (el > F.col("lines")), "end_line exceeds file line count"),
    ]
    said = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("nth"), F.lit(m).alias("m"))) for k, (c, m) in enumerate(checks))))
    found = rows.withColumn("said", said).where("size(said) > 0").select("place", "id", "t", F.explode("said").alias("p"))
    return found.select("place", "id", F.col("p.nth").alias("nth"), F.concat("t", F.lit(" "), F.col("id").cast("string"), F.lit(" "), "p.m").alias("problem"))


def foreign_key_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, column, parent, id) of references to rows that don't exist, among the tables given."""
    parts = []
    for child, column, parent in FOREIGN_KEYS:
        if child not in tables or parent not in tables or column not in tables[child].columns:
            continue
        c = tables[child].where(F.col(column).isNotNull()).select(F.col("id") if "id" in tables[child].columns else F.lit(None).cast("long").alias("id"), F.col(column).alias("ref"))
        lost = c.join(tables[parent].select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")
        parts.append(lost.select(F.lit(child).alias("child"), F.lit(column).alias("fk_column"), F.lit(parent).alias("parent"), "id"))
    return reduce(DataFrame.unionByName, parts)


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, status, problems): ``ok`` or ``failed (n)`` for each (id, problem) table, and its first ten problems."""
    parts = []
    for name, df in checks.items():
        n = df.agg(F.count(F.lit(1)).alias("n"))
        first = df.orderBy("id", "problem").limit(10).agg(F.array_sort(F.collect_list(F.struct("id", "problem"))).alias("p"))
        parts.append(
            n.crossJoin(first).select(  # one row each
                F.lit(name).alias("check_name"), F.when(F.col("n") == 0, "ok").otherwise(F.concat(F.lit("failed ("), F.col("n").cast("string"), F.lit(")"))).alias("status"),
                F.array_join(F.transform("p", lambda x: x["problem"]), "; ").alias("problems"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def physical_check(df: DataFrame) -> str:
    """``ok`` once every footer and row group of a stored table reads."""
    df.foreachPartition(lambda rows: [None for _ in rows] and None)
    return "ok"


