"""Ranked search over symbols and chunks: substring predicates, full text with BM25, and their merge."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import any_of

K1, B = 1.2, 0.75
FULL_TEXT_SCORE = 120
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def with_path(rows: DataFrame, file: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with the path of their file."""
    return rows.join(file.select(F.col("id").alias("__f"), F.col("path").alias("file_path")).hint("shuffle_hash"), F.col("file_id") == F.col("__f"), how).drop("__f")


def symbol_score(query: str) -> Column:
    """100 for a whole name, qualified name or key, 80 for its beginning, 60 for a part of it, 40 for a part of the path, else 0."""
    q, named = F.lit(query), [_low("name"), _low("qualified_name"), _low("symbol_key")]
    return (
        F.when(any_of([c == q for c in named]), 100).when(any_of([F.startswith(c, q) for c in named]), 80)
        .when(any_of([F.contains(c, q) for c in named]), 60).when(F.contains(_low("file_path"), q), 40).otherwise(0)
    )


def symbol_order() -> list[Column]:
    """Ties of a score: the name by which a symbol is known, its path, its line, its id. An empty name counts as none."""
    known = F.coalesce(F.nullif("qualified_name", F.lit("")), F.nullif("name", F.lit("")), F.lit(""))
    return [F.lower(known), _low("file_path"), F.coalesce("start_line", F.lit(0)), F.col("id")]


def search_symbols(node: DataFrame, file: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Symbols that hold the query, best first. A blank query finds nothing."""
    q = query.strip().lower()
    rows = with_path(node, file).withColumn("score", symbol_score(q) if q else F.lit(0)).where("score > 0")
    rows = rows.orderBy(F.desc("score"), *symbol_order())
    return rows if limit is None else rows.limit(limit)


def search_chunks(chunk: DataFrame, file: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """Chunks whose text begins with (80) or holds (60) the query."""
    q = query.strip().lower()
    text = _low("text")
    score = F.when(F.startswith(text, F.lit(q)), 80).when(F.contains(text, F.lit(q)), 60).otherwise(0) if q else F.lit(0)
    rows = with_path(chunk, file, "inner").withColumn("score", score).where("score > 0").orderBy(F.desc("score"), _low("file_path"), "start_line", "id")
    return rows if limit is None else rows.limit(limit)


def fold(text: Column) -> Column:
    """Case and Latin diacritics folded away."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def fold_words(text: str) -> list[str]:
    low = text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))
    return ["".join(c if c.isalnum() else " " for c in term).split() for term in low.split()]


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """(id, bm25) of the documents that hold every term of the query, a term of several words as a phrase; lower is better.

    Terms are runs of letters and digits. Each document is cut into its own where it lies and only counted: its length and how
    often it holds each phrase. What meets is one row of sums; scored are only those that hold every phrase.
    """
    phrases = [p for p in fold_words(query) if p]
    if not phrases:
        return docs.select("id", F.lit(0.0).alias("bm25")).limit(0)
    cut = docs.select("id", F.filter(F.split(fold(F.col("text")), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "").alias("words"))

    def times(phrase: list[str]) -> Column:
        begins = lambda w, i: reduce(lambda a, b: a & b, [F.get("words", i + k) == F.lit(x) for k, x in enumerate(phrase[1:], 1)], w == F.lit(phrase[0]))
        return F.size(F.filter("words", begins if len(phrase) > 1 else lambda w: w == F.lit(phrase[0])))

    counts = cut.select("id", F.size("words").alias("n_terms"), *(times(p).alias(f"f{k}") for k, p in enumerate(phrases)))
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("avglen"), *(F.count_if(F.col(f"f{k}") > 0).alias(f"df{k}") for k in range(len(phrases))))
    held = counts.where(reduce(lambda a, b: a & b, [F.col(f"f{k}") > 0 for k in range(len(phrases))]))

    def weight(k: int) -> Column:
        f, df = F.col(f"f{k}"), F.col(f"df{k}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_terms") / F.col("avglen")))

    return held.crossJoin(F.broadcast(stats)).select("id", (-reduce(lambda a, b: a + b, map(weight, range(len(phrases))))).alias("bm25"))  # one row


def symbol_documents(node: DataFrame, file: DataFrame) -> DataFrame:
    return with_path(node, file).select("id", F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("qualified_name", F.lit("")), F.coalesce("symbol_key", F.lit("")), F.coalesce("file_path", F.lit(""))).alias("text"))


def full_text(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score, rank): the best by BM25, all of them scored alike, above any substring hit."""
    best = bm25(docs, query).orderBy(F.round("bm25", 9), "id").limit(limit)
    return best.select("id", F.lit(FULL_TEXT_SCORE).alias("score"), F.row_number().over(Window.orderBy(F.round("bm25", 9), "id")).alias("rank"))  # ``limit`` rows


def merge(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two ranked lists (id, score, rank), the first before the second; an id keeps its first place."""
    both = first.select("id", "score", F.lit(0).alias("list"), "rank").unionByName(second.select("id", "score", F.lit(1).alias("list"), "rank"))
    kept = both.groupBy("id").agg(F.min(F.struct("list", "rank", "score")).alias("m")).select("id", "m.*")
    top = kept.orderBy("list", "rank").limit(limit)
    return top.select("id", "score", F.row_number().over(Window.orderBy("list", "rank")).alias("rank"))  # ``limit`` rows


def search(node: DataFrame, file: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Full text first, then substrings: (id, score, rank)."""
    like = search_symbols(node, file, query, limit)
    ranked = like.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), *symbol_order())).alias("rank"))  # ``limit`` rows
    return merge(full_text(symbol_documents(node, file), query, limit), ranked, limit)


def inspect_node(node: DataFrame, file: DataFrame, node_id: int) -> DataFrame:
    return with_path(node.where(F.col("id") == node_id), file)


def inspect_edge(edge: DataFrame, node: DataFrame, file: DataFrame, edge_id: int) -> DataFrame:
    """An edge with its file's path and what is known of both ends."""
    end = lambda p: node.select(F.col("id").alias(f"{p}_node_id"), F.col("name").alias(f"{p}_name"), F.col("qualified_name").alias(f"{p}_qualified_name"), F.col("kind").alias(f"{p}_kind"))
    one = with_path(edge.where(F.col("id") == edge_id), file)
    return one.join(end("src"), "src_node_id", "left").join(end("dst"), "dst_node_id", "left")
