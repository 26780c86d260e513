"""Selection under a token budget, as a fold over each request's ranked candidates, and what goes with it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as tx

MARKER = "\n... omitted remainder from compacted enclosing context ...\n"
LOW_VALUE = ("(*this)", "other", "self", "this", "values_")
ACCESSORS = ("empty", "has_value", "size", "value", "x", "y", "z")


def budget_key(goal: str) -> Column:
    """Sort key: file symbols first by kind, then the score for each token, the score, and the place."""
    symbol = F.col("kind") == "file.symbol"
    rank = F.when(F.col("node_kind") == "callable", 0.0).when(F.col("node_kind") == "type", 1.0).when(F.col("node_kind") == "field", 2.0).otherwise(3.0)
    effective = F.col("score")
    if goal == "failure-modes":
        bonus = F.when(F.coalesce("is_vendor", F.lit(False)), -5.0).otherwise(5.0)
        effective = F.when(F.startswith("kind", F.lit("diagnostic.")), effective + bonus).otherwise(effective)
    ratio = effective / F.greatest("token_estimate", F.lit(1))
    return F.struct(
        F.when(symbol, -10_000.0).otherwise(-ratio).alias("a"), F.when(symbol, rank).otherwise(-effective).alias("b"), F.coalesce("file", F.lit("")).alias("f"), F.coalesce("start_line", F.lit(0)).alias("s"), F.coalesce("end_line", F.lit(0)).alias("e"),
        F.col("family").alias("g"), F.col("ord").alias("o"),
    )


def name_of() -> Column:
    lines = F.when(F.col("start_line") == F.col("end_line"), F.col("start_line").cast("string")).otherwise(F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))
    return F.when(F.col("file").isNull() | F.col("start_line").isNull(), F.col("kind")).otherwise(F.concat("file", F.lit(":"), lines))


_TOLD = "request_id long, family int, ord int, kind string, place int, verdict string"


def _fold(batches: Iterable, budget: int, goal: str, max_items: int | None) -> Iterator:
    """Verdicts over rows in order: a request's required ones (``optional`` 0), then the optional ones."""
    import pyarrow as pa

    request, used, n, place, ranges, lost = object(), 0, 0, 0, {}, False
    for batch in batches:
        out = []
        for r, optional, family, ord_, kind, tokens, f, s, e, diagnostic, vendor, vendor_name in zip(*(c.to_pylist() for c in batch.columns)):
            if r != request:
                request, used, n, place, ranges, lost = r, 0, 0, 0, {}, False
            spans = f is not None and s is not None and e is not None and not diagnostic
            if not optional:
                used, n = used + (tokens or 0), n + 1
                if f is not None and s is not None and e is not None:
                    ranges.setdefault(f, []).append((s, e))
                continue
            place += 1
            if max_items is not None and n >= max_items:
                verdict = "max-items"
            elif spans and any((s <= b and a <= e) if goal == "explain" else (s <= a and e >= b) for a, b in ranges.get(f, ())):
                verdict = "overlap"
            elif (diagnostic and vendor and lost) or tokens is None or used + tokens > budget:
                verdict, lost = "budget", lost or not vendor_name
            else:
                verdict, used, n = "selected", used + tokens, n + 1
                if spans:
                    ranges.setdefault(f, []).append((s, e))
            out.append((r, family, ord_, kind, place, verdict))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()))], names=["request_id", "family", "ord", "kind", "place", "verdict"])


def verdicts(required: DataFrame, optional: DataFrame, budget: int, goal: str, max_items: int | None = None) -> DataFrame:
    """(request_id, family, ord, kind, place, verdict) of every scored optional candidate.

    Of the optional ones, in ``budget_key`` order: no room for items, then overlap (not for diagnostics),
    then the rule for vendored diagnostics (out once another path was refused for budget), then the
    budget. The fold is a stream over the request's candidates, sorted: its state holds what was
    selected, never the candidates, of which vendored diagnostics may give a request very many.
    """
    key, spans = budget_key(goal), ["start_line", "end_line"]
    have = lambda df, at: df.select(
        "request_id", F.lit(at).alias("optional"), F.col("family").cast("int").alias("family"), F.col("ord").cast("int").alias("ord"), "kind", F.col("token_estimate").cast("long").alias("tokens"), "file",
        *(F.col(c).cast("long").alias(c) for c in spans), F.startswith("kind", F.lit("diagnostic.")).alias("diagnostic"), F.coalesce("is_vendor", F.lit(False)).alias("vendor"), tx.is_vendor(name_of()).alias("vendor_name"),
        (key if at else F.lit(None)).alias("key"),
    )
    rows = have(optional, 1)
    rows = rows.unionByName(have(required, 0).withColumn("key", F.lit(None).cast(rows.schema["key"].dataType)))
    parts = [f"key.{c}" for c in "abfsego"]
    rows = rows.repartition("request_id").sortWithinPartitions("request_id", "optional", *parts).drop("key")
    return rows.mapInArrow(lambda batches: _fold(batches, budget, goal, max_items), _TOLD)


def select(required: DataFrame, optional: DataFrame, budget: int, goal: str, max_items: int | None = None) -> DataFrame:
    """Every scored candidate with ``verdict`` (selected, max-items, overlap, budget) and its ``place`` in the fold.

    Required candidates are always in, and their ranges count for overlap; for the optional ones, see ``verdicts``.
    """
    told = verdicts(required, optional, budget, goal, max_items).drop("kind")
    in_order = Window.partitionBy("request_id").orderBy("family", "ord")
    always = required.withColumn("place", F.row_number().over(in_order) - F.count(F.lit(1)).over(Window.partitionBy("request_id"))).withColumn("verdict", F.lit("selected"))
    return always.unionByName(optional.join(told, ["request_id", "family", "ord"]).select(*always.columns))


def ranks(selected: DataFrame) -> DataFrame:
    """The selected rows with their final rank: required first, then as the fold took them."""
    return selected.where("verdict = 'selected'").withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("place")))


def compact(required: DataFrame, budget: int) -> DataFrame:
    """Required enclosing candidates beyond a third of the budget (250 tokens at least), cut to whole lines, or characters if they have two at most."""
    limit = max(250, budget // 3)
    most = max(1, limit * 4 - len(MARKER))
    large = F.startswith("kind", F.lit("enclosing.")) & (F.col("token_estimate") > limit)
    lines = F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    room = limit * 4
    # lines fit as long as the kept text, without trailing white space, and the marker stay within the limit
    state = "struct<t:string,n:int,open:boolean>"
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("open")).cast(state)

    def keep(s, line):
        tried = F.concat(s["t"], line)
        fits = s["open"] & (F.length(F.regexp_replace(tried, r"\s+$", "")) + len(MARKER) <= room)
        return F.struct(F.when(fits, tried).otherwise(s["t"]).alias("t"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open")).cast(state)

    bare = lambda c: F.regexp_replace(c, r"\s+$", "")
    df = required.withColumn("__large", large).withColumn("__lines", F.when(large, lines)).withColumn("__kept", F.when(large, F.aggregate("__lines", start, keep)))
    left = F.size("__lines") - F.col("__kept.n")
    cut = F.concat(bare(F.substring("text", 1, most)), F.lit(MARKER))
    short = F.when((F.size("__lines") <= 2) | (F.col("__kept.n") == 0), cut).when(left == 0, F.col("text"))
    done = F.coalesce(short, F.concat(bare(F.col("__kept.t")), F.lit("\n... omitted "), left.cast("string"), F.lit(" lines from compacted enclosing context ...\n")))
    df = df.withColumn("original_token_estimate", F.when(F.col("__large"), F.col("token_estimate"))).withColumn("text", F.when(F.col("__large"), done).otherwise(F.col("text")))
    return df.withColumn("token_estimate", F.when(F.col("__large"), tx.token_estimate(F.col("text"))).otherwise(F.col("token_estimate"))).drop("__large", "__lines", "__kept")


def grouped_notes(unresolved: DataFrame) -> DataFrame:
    """(request_id, note, first): unresolved targets counted, without those that say little, in the order they came."""
    target = F.regexp_replace(F.trim(F.regexp_replace("unresolved", r"\s+", " ")), r"\.$", "")
    receiver = F.substring_index(F.col("target"), ".", 1)
    rows = unresolved.withColumn("target", target).where((F.col("target") != "") & ~F.col("target").isin(*LOW_VALUE) & ~receiver.isin(*LOW_VALUE))
    g = rows.groupBy("request_id", "edge_kind", "target").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    noise = (F.col("n") >= 2) & F.contains("target", F.lit(".")) & ~F.contains("target", F.lit(":")) & ~F.contains("target", F.lit("->")) & F.substring_index("target", ".", -1).isin(*ACCESSORS)
    note = F.concat(F.lit("unresolved "), "edge_kind", F.lit(": "), "target", F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" occurrences)"))).otherwise(""))
    return g.where(~noise).select("request_id", note.alias("note"), "first")
