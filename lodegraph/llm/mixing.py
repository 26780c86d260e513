"""Mixing by iterative proportional fitting: token weights are raked to marginals, then documents are sampled.

The tokens of every (source, language, topic) cell are summed; the cells' weights start there and are
scaled in turn to the target share of each source, language and topic, ``ROUNDS`` times over. A
document's probability is its cell's final weight over its tokens, divided by the largest such ratio,
so the expected sample has the target shares and no probability exceeds one. A document is kept if a
hash of its id falls below it, which is the same on every run and for any partitioning.

The expected sample holds at least ``budget`` of the tokens that the targets admit. Where the largest
ratio would make it smaller, the weights are scaled to the budget instead: cells whose weight would
exceed their tokens are kept whole, and the others are raked to what is left of the targets. Such
cells miss their targets, and nothing else pays for it.

Targets of a margin are given as shares by key, or as a power: ``0.5`` means shares in proportion to
the square root of the tokens. Keys without a target share their margin's rest as they are. Shares
are rescaled over the keys that hold tokens.

Null source, language or topic are keys of their own. Null or empty text has no tokens; such
documents take their cell's probability, or 1 where the whole cell has no tokens. A null doc_id counts
as the empty string. Rows repeated under one doc_id are kept or left together. An empty table gives an
empty result. Columns of the input keep their values, whatever their names.

Scale: the texts are read once, without a shuffle. Cells are combined map-side, so a source with a
third of all rows is one row a task. The cell table is a DataFrame throughout; Spark's own size check
decides whether its joins broadcast it or sort.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

ROUNDS = 6
MARGINS = ("mix_source", "mix_lang", "mix_topic")
#: Least expected share of the tokens in a sample. The SQL twin knows no full cells, so it holds where a sample without them
#: is as large already (38 % of the tokens at least in the tables here).
BUDGET = 1 / 3
#: Rounds of filling cells; if some would still overflow then, the budget is met by one common factor.
FILLS = 12
#: Default targets, which need not suit a corpus: scarce keys miss theirs (see above).
SOURCE_POWER = 0.7
LANG_SHARES = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
TOPIC_SHARES = {"table": 0.03}
SEED = "mix-1"


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def topic(text: Column) -> Column:
    """A document's form: rows of cells, a brief text, or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.length(t) < 400, "brief").otherwise("prose")


def unit(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def _targets(cells: DataFrame, margin: str, target: float | Mapping[str, float]) -> DataFrame:
    """(key, share) over the keys of a margin that hold tokens; shares sum to one."""
    held = cells.groupBy(margin).agg(F.sum("mix_tokens").cast("double").alias("held")).where("held > 0")
    if isinstance(target, Mapping):
        named = F.create_map(*(F.lit(x) for kv in target.items() for x in (kv[0], float(kv[1])))) if target else F.lit(None).cast("map<string,double>")
        total = held.agg(F.sum("held")).first()[0] or 0.0
        sized = held.select(margin, F.coalesce(F.try_element_at(named, F.col(margin)), F.col("held") / F.lit(total)).alias("raw"))
    else:
        sized = held.select(margin, F.pow("held", F.lit(float(target))).alias("raw"))
    whole = sized.agg(F.sum("raw")).first()[0] or 1.0
    return sized.select(F.col(margin).alias("key"), (F.col("raw") / F.lit(whole)).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``weight``: tokens raked to every margin in turn. Cells without tokens get weight 0."""
    wanted = {m: materialize(_targets(cells, m, t), "targets") for m, t in targets.items()}
    now = _rounds(cells.withColumn("weight", F.col("mix_tokens").cast("double")), wanted, rounds)
    for want in wanted.values():
        drop_scratch(want)
    return now


def _rounds(now: DataFrame, wanted: Mapping[str, DataFrame], rounds: int) -> DataFrame:
    held = None
    for _ in range(rounds):
        for m, want in wanted.items():
            sums = now.groupBy(m).agg(F.sum("weight").alias("sum")).select(F.col(m).alias("key"), "sum")
            factor = sums.join(want, sums["key"].eqNullSafe(want["key"])).select(sums["key"], F.when(F.col("sum") > 0, F.col("share") / F.col("sum")).otherwise(0.0).alias("factor"))
            now = now.join(factor, now[m].eqNullSafe(factor["key"]), "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("key", "factor")
        now = materialize(now, "raked")
        drop_scratch(held)
        held = now
    return now


def _rake_rest(cells: DataFrame, targets: Mapping[str, DataFrame], budget: float, rounds: int) -> DataFrame:
    """``weight`` of the cells that aren't full, raked to what the full ones leave of every target. A key keeps a hundredth of its own at least."""
    full = F.sum(F.when(F.col("full"), F.col("mix_tokens")).otherwise(0)).cast("double")
    left = budget - (cells.agg(full).first()[0] or 0.0)
    wanted = {}
    for m, want in targets.items():
        sums = cells.groupBy(m).agg(full.alias("gone"), F.bool_or(~F.col("full") & (F.col("weight") > 0)).alias("open")).where("open")
        goal = F.col("share") * F.lit(budget)
        rest = sums.join(want, sums[m].eqNullSafe(want["key"])).select("key", F.greatest(goal - F.col("gone"), goal * 0.01).alias("raw"))
        whole = rest.agg(F.sum("raw")).first()[0] or 1.0
        wanted[m] = materialize(rest.select("key", (F.col("raw") * F.lit(left / whole)).alias("share")), "rest")
    now = _rounds(cells.where("NOT full"), wanted, rounds)
    for want in wanted.values():
        drop_scratch(want)
    return now.unionByName(cells.where("full").withColumn("weight", F.col("mix_tokens").cast("double")))


def fill(raked: DataFrame, targets: Mapping[str, float | Mapping[str, float]], budget: float, rounds: int = ROUNDS) -> DataFrame:
    """``raked`` with weights that sum to ``budget`` tokens, none above its cell's tokens (see the module's head)."""
    shares = {m: materialize(_targets(raked.select(*targets, "mix_tokens"), m, t), "targets") for m, t in targets.items()}
    total = raked.agg(F.sum("weight")).first()[0]
    now = materialize(raked.withColumn("weight", F.col("weight") * F.lit(budget / total)).withColumn("full", F.lit(False)), "filled")
    for _ in range(FILLS):
        over = ~F.col("full") & (F.col("weight") >= F.col("mix_tokens")) & (F.col("mix_tokens") > 0)
        if not now.where(over).limit(1).count():
            break
        following = now.withColumn("full", F.col("full") | over)
        following = materialize(_rake_rest(following, shares, budget, rounds), "filled")
        drop_scratch(now)
        now = following
    for want in shares.values():
        drop_scratch(want)
    return _level(now.drop("full"), budget)


def _level(cells: DataFrame, budget: float) -> DataFrame:
    """Weights times the one factor with which, cut at the cells' tokens, they sum to ``budget``."""
    low, high = 0.0, 1.0
    held = lambda x: cells.agg(F.sum(F.least(F.col("weight") * F.lit(x), F.col("mix_tokens").cast("double")))).first()[0]
    if abs(held(1.0) - budget) > 1e-9 * budget:
        while held(high) < budget * (1 - 1e-9) and high < 1e12:
            high *= 2
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if held(mid) < budget else (low, mid)
            if high - low < 1e-9 * high:
                break
    return cells.withColumn("weight", F.least(F.col("weight") * F.lit(high), F.col("mix_tokens").cast("double")))


def probabilities(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """(margins, mix_p): the probability of a document in each cell."""
    raked = rake(cells, targets, rounds).withColumn("ratio", F.when(F.col("mix_tokens") > 0, F.col("weight") / F.col("mix_tokens")))
    top, weight, admitted = raked.agg(F.max("ratio"), F.sum("weight"), F.sum(F.when(F.col("weight") > 0, F.col("mix_tokens")))).first()
    least = budget * (admitted or 0)
    if top and weight / top < least:
        raked, top = fill(raked.drop("ratio"), targets, least, rounds).withColumn("ratio", F.when(F.col("mix_tokens") > 0, F.col("weight") / F.col("mix_tokens"))), 1.0
    return raked.select(*MARGINS, F.coalesce(F.round(F.col("ratio") / F.lit(top or 1.0), 9), F.lit(1.0)).alias("mix_p"))


TARGETS = {"mix_source": SOURCE_POWER, "mix_lang": LANG_SHARES, "mix_topic": TOPIC_SHARES}


def _with_margins(docs: DataFrame, *kept: Column | str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        *kept, F.col("source").cast("string").alias("mix_source"), F.col("lang").cast("string").alias("mix_lang"), topic(text).alias("mix_topic"), tokens(text).alias("mix_tokens")
    )


def _decide(rows: DataFrame, cells: DataFrame, targets, seed: str) -> DataFrame:
    p = materialize(probabilities(cells, targets), "probabilities")
    joined = rows.join(p.select(*(F.col(m).alias("k_" + m) for m in MARGINS), "mix_p"), [rows[m].eqNullSafe(F.col("k_" + m)) for m in MARGINS], "left")
    return joined.drop(*("k_" + m for m in MARGINS)).withColumn("mix_kept", unit(F.col("doc_id"), seed) < F.col("mix_p"))


def _cells(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy(*MARGINS).agg(F.sum("mix_tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_docs")), "cells")


def mix(docs: DataFrame, targets=TARGETS, seed: str = SEED) -> DataFrame:
    """doc_id, the margins, tokens, probability and decision of every document."""
    rows = materialize(_with_margins(docs, "doc_id"), "margins")
    return _decide(rows, _cells(rows), targets, seed)


def sample(docs: DataFrame, targets=TARGETS, seed: str = SEED) -> DataFrame:
    """The kept rows of ``docs``, with its own columns. ``docs`` must be a written table: its texts are read for the cells, then for the rows."""
    rows = _with_margins(docs, "doc_id", F.struct(*docs.columns).alias("mix_row"))
    return _decide(rows, _cells(_with_margins(docs)), targets, seed).where("mix_kept").select("mix_row.*")


def oracle_sql(documents: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``mix`` with the default targets: every step of the fitting is a table of its own."""
    shares = {
        "mix_source": "power(held, %r)" % SOURCE_POWER,
        "mix_lang": "CASE mix_lang %s ELSE held / (SELECT sum(held) FROM h_mix_lang) END" % " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_SHARES.items()),
        "mix_topic": "CASE mix_topic %s ELSE held / (SELECT sum(held) FROM h_mix_topic) END" % " ".join(f"WHEN '{k}' THEN {v}" for k, v in TOPIC_SHARES.items()),
    }
    out = [
        f"""mix_rows AS MATERIALIZED (SELECT doc_id, source AS mix_source, lang AS mix_lang,
 CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN length(coalesce(text, '')) < 400 THEN 'brief' ELSE 'prose' END AS mix_topic,
 CAST((length(coalesce(text, '')) + 3) // 4 AS BIGINT) AS mix_tokens FROM {documents})""",
        "w_0 AS MATERIALIZED (SELECT mix_source, mix_lang, mix_topic, CAST(sum(mix_tokens) AS BIGINT) AS mix_tokens, CAST(sum(mix_tokens) AS DOUBLE) AS weight FROM mix_rows GROUP BY ALL)",
    ]
    for m, raw in shares.items():
        out.append(f"h_{m} AS MATERIALIZED (SELECT {m}, CAST(sum(mix_tokens) AS DOUBLE) AS held FROM w_0 GROUP BY {m} HAVING sum(mix_tokens) > 0)")
        out.append(f"r_{m} AS MATERIALIZED (SELECT {m} AS key, {raw} AS raw FROM h_{m})")
        out.append(f"s_{m} AS MATERIALIZED (SELECT key, raw / (SELECT sum(raw) FROM r_{m}) AS share FROM r_{m})")
    k = 0
    for _ in range(rounds):
        for m in shares:
            out.append(f"""w_{k + 1} AS MATERIALIZED (SELECT w.mix_source, w.mix_lang, w.mix_topic, w.mix_tokens,
 w.weight * coalesce(CASE WHEN f.sum > 0 THEN t.share / f.sum ELSE 0 END, 0) AS weight
 FROM w_{k} w LEFT JOIN (SELECT {m} AS key, sum(weight) AS sum FROM w_{k} GROUP BY {m}) f ON w.{m} IS NOT DISTINCT FROM f.key
 LEFT JOIN s_{m} t ON w.{m} IS NOT DISTINCT FROM t.key)""")
            k += 1
    out.append(f"""mix_p AS MATERIALIZED (SELECT mix_source, mix_lang, mix_topic,
 coalesce(round(weight / nullif(mix_tokens, 0) / (SELECT max(weight / nullif(mix_tokens, 0)) FROM w_{k}), 9), 1.0) AS mix_p FROM w_{k})""")
    number = f"CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / {float(16**13)!r}"
    return "WITH " + ",\n".join(out) + f"""
SELECT r.doc_id, r.mix_source, r.mix_lang, r.mix_topic, r.mix_tokens, p.mix_p, {number} < p.mix_p AS mix_kept
FROM mix_rows r JOIN mix_p p ON r.mix_source IS NOT DISTINCT FROM p.mix_source AND r.mix_lang IS NOT DISTINCT FROM p.mix_lang AND r.mix_topic IS NOT DISTINCT FROM p.mix_topic"""
