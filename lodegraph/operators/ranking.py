"""Additive scores of context candidates, as column arithmetic with a trace of every part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import any_of

_RELATIONS = ("calls", "uses_type", "references", "import", "include")
#: goal -> weight of each relation, in the order of ``_RELATIONS``.
POLICIES = {"explain": (2.0, 1.7, 1.5, 0.8, 0.8), "failure-modes": (1.4, 1.2, 1.8, 0.5, 0.5), "dependencies": (1.0, 2.2, 1.4, 1.6, 1.6), "call-neighborhood": (2.5, 0.8, 1.0, 0.3, 0.3)}
FAILURE_WORDS = "error exception fail failure guard invalid null throw validate".split()
DEPENDENCY_WORDS = "client dependency factory gateway provider repository service".split()
CONSTRUCTOR_WORDS = ("<init>", "constructor", "create", "init")


def policy(goal: str) -> dict[str, float]:
    return dict(zip(_RELATIONS, POLICIES.get(goal, POLICIES["explain"])))


def _low(c: str | Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def edge_relevance(goal: str) -> Column:
    key = F.coalesce("edge_kind", "kind")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in policy(goal).items() for x in kv)), key), F.lit(0.0))


def needle(anchored: bool) -> Column:
    """The query's text, else (for a line anchor) the anchor's name; empty for none."""
    return F.when(_low("query") != "", _low("query")).otherwise(_low("anchor_name") if anchored else F.lit(""))


def exact_match() -> Column:
    n = needle(True)
    return (n != "") & any_of([n == _low(c) for c in ("node_name", "qualified_name", "symbol_key")])


def lexical_match(anchored: bool) -> Column:
    n = needle(anchored)
    return (n != "") & any_of([F.contains(_low(c), n) for c in ("file", "text", "node_name", "qualified_name", "symbol_key")])


def source_proximity() -> Column:
    same = (F.col("file") == F.col("anchor_file")) & F.col("start_line").isNotNull()
    s, e, line = F.col("start_line"), F.col("end_line"), F.col("anchor_line")
    away = F.least(F.abs(line - s), F.abs(line - e), F.lit(20))
    return F.when(same & (s <= line) & (line <= e), 1.2).when(same, F.round(1.2 * (1.0 - away / 20.0), 4)).otherwise(0.0)


def is_test_context() -> Column:
    return F.startswith("kind", F.lit("test.")) | F.contains(F.lower(F.coalesce("file", F.lit(""))), F.lit("test"))


def confidence() -> Column:
    return F.round(0.5 * F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), 4)


def token_cost() -> Column:
    return -F.round(0.8 * F.least(F.col("token_estimate") / 1000.0, F.lit(1.0)), 4)


def _words(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))


def goal_relevance(goal: str) -> Column:
    kind, edge = F.col("kind"), F.coalesce("edge_kind", F.lit(""))
    if goal == "failure-modes":
        text = _words("kind", "file", "text", "node_name", "qualified_name", "symbol_key")
        relation = F.coalesce("diagnostic_relation", F.lit(""))
        diagnostic = F.when(F.coalesce("is_vendor", F.lit(False)), 0.5).when(relation == "anchor-file", 4.0).when(relation == "related", 2.0).otherwise(0.0)
        return F.when(F.startswith(kind, F.lit("diagnostic.")), diagnostic).when(any_of([F.contains(text, F.lit(w)) for w in FAILURE_WORDS]), 4.0).when((edge == "references") & (F.col("confidence") < 0.6), 1.0).otherwise(0.0)
    if goal == "call-neighborhood":
        return F.when(kind == "neighborhood.caller", 2.0).when(kind == "neighborhood.callee", 1.8).when(edge == "calls", 1.0).otherwise(0.0)
    if goal == "dependencies":
        text = _words("kind", "file", "text", "node_name", "qualified_name")
        parts = F.filter(F.split(F.replace(F.coalesce("qualified_name", F.lit("")), F.lit("::"), F.lit(".")), r"\."), lambda p: p != "")
        name = F.coalesce("node_name", F.lit(""))
        own = (name != "") & (F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(-2)) == name) & F.startswith(F.try_element_at(parts, F.lit(-1)), F.concat(name, F.lit("(")))
        built = F.contains(F.lower(F.coalesce("callable_kind", F.lit(""))), F.lit("constructor"))
        return (
            F.when(kind.isin("import", "include"), 2.0).when(edge == "uses_type", 2.4).when((edge == "references") | (F.coalesce("node_kind", F.lit("")) == "field"), 2.0).when(built, 1.6).when(F.coalesce(own, F.lit(False)), 1.6)
            .when((edge == "calls") & any_of([F.contains(text, F.lit(w)) for w in CONSTRUCTOR_WORDS]), 1.2).when(any_of([F.contains(text, F.lit(w)) for w in DEPENDENCY_WORDS]), 1.0).otherwise(0.0)
        )
    return F.lit(0.0)


def line_components(goal: str) -> dict[str, Column]:
    return {
        "target": _if(F.startswith("kind", F.lit("target.")), 5.0), "exact_match": _if(exact_match(), 3.0), "edge_relevance": edge_relevance(goal), "graph_proximity": _if(F.col("edge_id").isNotNull(), 1.5),
        "source_proximity": source_proximity(), "lexical_match": _if(lexical_match(True), 1.0), "enclosing_context": _if(F.startswith("kind", F.lit("enclosing.")), 0.8), "test_context": _if(is_test_context(), 0.7),
        "confidence": confidence(), "token_cost": token_cost(), "redundancy": F.lit(0.0), "goal_relevance": goal_relevance(goal),
    }


def file_components(goal: str) -> dict[str, Column]:
    noise = F.when(F.col("kind").isin("import", "include"), -0.8).when(F.col("kind") == "test.related", -1.0).otherwise(0.0) if goal == "explain" else F.lit(0.0)
    zero = F.lit(0.0)
    return {
        "target": zero, "exact_match": zero, "edge_relevance": edge_relevance(goal), "graph_proximity": _if(F.col("edge_id").isNotNull(), 1.5), "source_proximity": zero,
        "file_outline": _if(F.col("kind") == "file.outline", 4.0), "file_symbol": _if(F.col("kind") == "file.symbol", 2.2), "same_file": _if(F.coalesce(F.col("file") == F.col("anchor_file"), F.lit(False)), 1.4),
        "lexical_match": _if(lexical_match(False), 1.0), "enclosing_context": zero, "test_context": _if(is_test_context(), 0.7), "file_anchor_noise": noise, "confidence": confidence(), "token_cost": token_cost(),
        "redundancy": zero, "goal_relevance": goal_relevance(goal),
    }


def score(candidates: DataFrame, goal: str, of_file: bool = False) -> DataFrame:
    """``candidates`` (with their anchor's columns and the query) with ``score`` and the map ``score_trace``."""
    parts = (file_components if of_file else line_components)(goal)
    named = {f"__{k}": v for k, v in parts.items()}
    out = candidates.withColumns(named)
    total = F.round(reduce(lambda a, b: a + b, (F.col(c) for c in named)), 4)
    # a goal without relevance leaves no entry, as every other part does even at zero
    pairs = F.map_from_arrays(F.array(*map(F.lit, (*parts, "total"))), F.array(*(F.col(f"__{k}") for k in parts), F.col("score")))
    trace = F.map_filter(pairs, lambda k, v: (k != "goal_relevance") | (v != 0))
    return out.withColumn("score", total).withColumn("score_trace", trace).drop(*named)
