"""Token counts: an exact histogram of encoded lengths with suffix sums.

A document's encoded length is its number of ids from the tokenizer, plus ``extra`` (such as one end
token). The histogram has a row for every distinct length; its suffix sums answer, for every context
limit, how many documents are longer, how many tokens truncation keeps, and any quantile.

Null and empty texts have length ``extra``. An empty table gives an empty histogram. Other columns
are ignored. Equal rows count each time.

Scale: lengths are counted inside each task, so a task sends one row per distinct length; the window
runs over distinct lengths (at most the longest length), not over documents, in ranges that are
summed first, so no task holds more than a range.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import default_tokenizer, encoder

#: Lengths of one range of the suffix sums.
RANGE = 4096


def length_counts(docs: DataFrame, tokenizer: str | None = None, extra: int = 0, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs), one row per distinct encoded length."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        seen: Counter[int] = Counter()
        for b in batches:
            texts = b.column("text")
            for at in range(0, len(texts), 256):
                seen.update(len(x) // 4 + extra for x in encoder(path).encode(texts.slice(at, 256).to_pylist()))
        if seen:
            lengths = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array([seen[x] for x in lengths], pa.int64())], ["n_tokens", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n long")
    return counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Per length L: documents and tokens at L, at L or beyond, up to L, and the tokens that a limit of L keeps."""
    counts = materialize(counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    banded = counts.withColumn("band", F.floor(F.col("n_tokens") / RANGE))
    bands = banded.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over ranges only
    later = bands.select("band", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    whole = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens")).first()
    down = Window.partitionBy("band").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = banded.join(later, "band").select(
        "n_tokens", "n_docs", "tokens",
        (F.sum("n_docs").over(down) + F.col("d_after")).alias("docs_from"),
        (F.sum("tokens").over(down) + F.col("t_after")).alias("tokens_from"),
    )
    docs, tokens = (F.lit(int(whole[0] or 0)), F.lit(int(whole[1] or 0)))
    beyond = F.col("docs_from") - F.col("n_docs")
    return at.select(
        "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from",
        (docs - beyond).alias("docs_up_to"),
        F.round((docs - beyond) / docs, 9).alias("quantile"),
        (tokens - F.col("tokens_from") + F.col("tokens") + F.col("n_tokens") * beyond).alias("kept_at_limit"),
        (F.col("tokens_from") - F.col("tokens") - F.col("n_tokens") * beyond).alias("cut_at_limit"),
    )


def length_histogram(docs: DataFrame, tokenizer: str | None = None, extra: int = 0) -> DataFrame:
    return suffix_sums(length_counts(docs, tokenizer, extra))


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for given context limits, any numbers: documents longer than the limit, tokens kept and tokens cut."""
    longer = F.when(F.col("n_tokens") > F.col("n_limit"), F.col("n_docs")).otherwise(0)
    asked = F.array(*(F.lit(int(x)) for x in limits)).cast("array<long>")
    return (
        histogram.select("n_tokens", "n_docs", F.explode(asked).alias("n_limit"))
        .groupBy("n_limit")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum(longer).alias("docs_longer"), F.sum(F.least("n_tokens", "n_limit") * F.col("n_docs")).alias("tokens_kept"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    )


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least the fraction ``q`` of the documents don't exceed; None of nothing."""
    return histogram.where(F.col("quantile") >= q - 1e-12).agg(F.min("n_tokens")).first()[0]
