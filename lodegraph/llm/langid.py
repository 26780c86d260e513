"""Language identification by interpolated Kneser-Ney character models, one per language.

Letters (lower-cased) are numbered, all that the sample has (codes of n-grams fit 64 bits up to ``LETTERS`` of them,
beyond which the rarest would be one); everything else is a word boundary, and runs of boundaries are one. Each language gets a model of order ``ORDER`` with absolute discounting: raw counts at the top
order, continuation counts (distinct left neighbours) below, interpolated down to uniform. The n-grams
of all languages share sorted arrays of codes, in which a text's n-grams are found by binary search;
beside each code stand the log probabilities under every language, so one search serves all. An
unseen n-gram falls back on its context's interpolation weight and the next lower order.

A text gets the language with the lowest cross-entropy per scored character. It is ``rejected`` if
that cross-entropy exceeds what texts of the language have: the limit is calibrated on a held-back
fifth of the training sample, as an excess over the mean that shrinks with the root of the length. Of that
fifth only language, length and cross-entropy come to the driver.

The model is fitted on a bounded sample: about ``TRAIN_DOCS`` documents a language (all if there are
fewer), picked by a hash of id and text, whole texts; prediction covers every whole text and uses nothing
but the text. Null text or no letter: ``und``, score 0, rejected. No labelled row: every text is
``und``. Ties go to the first language in code order. Empty table: empty result. Repeated rows are
predicted each. Other columns are ignored.

Scale: prediction is one pass without a shuffle; the model is some megabytes, bounded by the sample.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ORDER = 4
TRAIN_DOCS = 1500
LETTERS = 55_000
#: Positions scored at once.
SLICE = 1 << 18
_GAP = ORDER - 1
#: The excess beyond the largest that calibration saw, as a multiple, at which a text is rejected.
MARGIN = 2.0


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its single lower-case form, and whether it is a letter."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            letter[cp] = True
            if len(low := c.lower()) == 1:
                lower[cp] = ord(low)
    return lower, letter


def numbering(alphabet: list[int]) -> np.ndarray:
    """Code point -> number: 0 boundary, 1 other letter, 2... the alphabet's letters."""
    lower, letter = _classes()
    own = np.zeros(0x110000, np.uint16)
    own[np.array(alphabet, np.int64)] = np.arange(2, 2 + len(alphabet))
    out = own[lower]
    out[letter & (out == 0)] = 1
    out[~letter] = 0
    return out


def encode(texts: list[str | None], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts, each after ``_GAP`` boundaries, and each text's count of numbers without that gap."""
    sep = "\n" * _GAP
    joined = sep + sep.join(t or "" for t in texts)
    ids = lut[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    sizes = np.array([len(t or "") for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + _GAP))) if len(sizes) else np.zeros(0, np.int64)
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    for g in range(_GAP):
        keep[starts + g] = True
    ends = np.concatenate(([0], np.cumsum(keep)))
    return ids[keep], ends[starts + _GAP + sizes] - ends[starts + _GAP]


def codes(ids: np.ndarray, base: int, order: int = ORDER) -> np.ndarray:
    """The code of the n-gram that ends at each position from ``order - 1`` on."""
    n = len(ids) - order + 1
    out = np.zeros(max(n, 0), np.int64)
    for k in range(order):
        out = out * base + ids[k : k + n]
    return out


class Model:
    """Sorted codes by order with log probabilities, and sorted contexts with log interpolation weights."""

    def __init__(self, alphabet: list[int], langs: list[str], tops: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.alphabet, self.langs, self.base = alphabet, langs, len(alphabet) + 2
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)] * (ORDER + 1)
        self.logp: list[np.ndarray] = [np.zeros((0, len(langs)))] * (ORDER + 1)
        self.contexts: list[np.ndarray] = [np.zeros(0, np.int64)] * (ORDER + 1)
        self.loglam: list[np.ndarray] = [np.zeros((0, len(langs)))] * (ORDER + 1)
        self.mean = np.zeros(len(langs))
        self.limit = np.full(len(langs), np.inf)
        counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for lang in langs:
            grams, n = tops[lang]
            for order in range(ORDER, 0, -1):
                counts[lang, order] = (grams, n)
                grams, n = np.unique(grams % self.base ** (order - 1), return_counts=True)  # distinct left neighbours
        for order in range(1, ORDER + 1):
            self._fit(order, [counts[lang, order] for lang in langs])

    def _fit(self, order: int, counted: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.unique(np.concatenate([k for k, _ in counted])) if order > 1 else np.arange(self.base)
        contexts = np.unique(keys // self.base)
        lower = np.exp(self.log_probs(keys % self.base ** (order - 1), order - 1)) if order > 1 else np.full((len(keys), len(counted)), 1.0 / self.base)
        p, lam = np.empty((len(keys), len(counted))), np.ones((len(contexts), len(counted)))
        at = np.searchsorted(contexts, keys // self.base)
        for j, (grams, n) in enumerate(counted):
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, grams)] = n
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, c > 0, len(contexts))
            seen = total > 0
            lam[seen, j] = d * kinds[seen] / total[seen]
            p[:, j] = np.maximum(c - d, 0) / np.maximum(total, 1)[at] + lam[at, j] * lower[:, j]
        self.keys[order], self.logp[order] = keys, np.log(p).astype(np.float32)
        self.contexts[order], self.loglam[order] = contexts, np.log(lam).astype(np.float32)

    def log_probs(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(positions, languages) by binary search, falling back on lower orders."""
        if order == 1:
            return self.logp[1][grams]
        keys = self.keys[order]
        at = np.searchsorted(keys, grams)
        at[at == len(keys)] = 0
        out = self.logp[order][at]
        miss = np.flatnonzero(keys[at] != grams)
        if len(miss):
            rest = self.log_probs(grams[miss] % self.base ** (order - 1), order - 1)
            context, known = grams[miss] // self.base, self.contexts[order]
            k = np.searchsorted(known, context)
            k[k == len(known)] = 0
            seen = known[k] == context
            rest[seen] += self.loglam[order][k[seen]]
            out[miss] = rest
        return out

    def entropies(self, texts: list[str | None], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a scored position (texts, languages), and the positions of each text."""
        ids, n = encode(texts, lut)
        sums = np.zeros((len(texts), len(self.langs)))
        grams = codes(ids, self.base)
        # position k of ``grams`` ends at ids[k + _GAP]; text j's own positions start after all gaps up to it
        owner = np.repeat(np.arange(len(texts)), n)
        first = np.cumsum(n) - n + _GAP * np.arange(len(texts))
        position = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        for s in range(0, len(position), SLICE):
            part = slice(s, s + SLICE)
            logs, who = self.log_probs(grams[position[part]]), owner[part]
            cut = np.flatnonzero(np.diff(who)) + 1
            begin = np.concatenate(([0], cut))
            sums[who[begin]] += np.add.reduceat(logs, begin, axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], n

    def excess(self, h: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        return (h[np.arange(len(h)), best] - self.mean[best]) * np.sqrt(np.minimum(n, 400))

    def predict(self, texts: list[str | None], lut: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies, rejections."""
        h, n = self.entropies(texts, lut)
        best = h.argmin(axis=1)
        w = np.exp(-(h - h.min(axis=1, keepdims=True)) * np.minimum(n, 64)[:, None])
        score = np.where(n > 0, 1 / w.sum(axis=1), 0.0)
        rejected = (n == 0) | (self.excess(h, n, best) > self.limit[best])
        names = [self.langs[b] if k else "und" for b, k in zip(best, n)]
        return names, score, np.where(n > 0, h[np.arange(len(h)), best], np.nan), rejected

    def calibrate(self, own: np.ndarray, n: np.ndarray, h: np.ndarray) -> None:
        """Mean and largest excess of held-back texts (number of the language, length, cross-entropy) under their own language's model."""
        for j in range(len(self.langs)):
            mine = (own == j) & (n > 0)
            if mine.sum() < 5:  # too few to say anything by themselves: all languages' texts together
                mine = n > 0
            if mine.any():
                self.mean[j] = np.average(h[mine], weights=n[mine])
                over = (h[mine] - self.mean[j]) * np.sqrt(np.minimum(n[mine], 400))
                self.limit[j] = MARGIN * max(float(np.quantile(over, 0.999)), 1.0)


def training_sample(docs: DataFrame, allowed: Column, lang_col: str = "lang", per_lang: int = TRAIN_DOCS) -> DataFrame:
    """About ``per_lang`` labelled documents of each language, and whether each is held back for calibration."""
    rows = docs.where(F.col("text").isNotNull() & F.col(lang_col).isNotNull() & allowed)
    counted = materialize(rows.groupBy(F.col(lang_col).cast("string").alias("__of")).agg(F.count(F.lit(1)).alias("__n")), "languages")  # written: its size is known to the join
    drawn = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string")), F.lit(n))
    rows, share = rows.join(counted, F.col(lang_col).cast("string") == F.col("__of")), F.lit(per_lang) / F.col("__n")
    unit, back = drawn("langid", 1_000_003) / 1_000_003, drawn("calibrate", 5) == 0
    return rows.where(unit < share).select(F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), back.alias("held_back"))


def train(sample: DataFrame) -> Model | None:
    """Fit on a (bounded) sample of (text, lang, held_back); None if it has no letter."""

    def letters(batches):
        lower, letter = _classes()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                joined = "".join(b.column("text").slice(at, 200).to_pylist())
                cps = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
                cp, n = np.unique(lower[cps[letter[cps]]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cp, pa.int32()), pa.array(n, pa.int64())], ["cp", "n"])

    counted = sample.mapInArrow(letters, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    alphabet = sorted(r.cp for r in counted.orderBy(F.desc("n"), "cp").limit(LETTERS).collect())
    if not alphabet:
        return None
    lut, base = numbering(alphabet), len(alphabet) + 2

    def grams(batches):
        mine = numbering(alphabet)
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs):
                where = np.flatnonzero(langs == lang)
                for at in range(0, len(where), 100):
                    ids, n = encode(b.column("text").take(pa.array(where[at : at + 100])).to_pylist(), mine)
                    first = np.cumsum(n) - n + _GAP * np.arange(len(n))
                    position = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    code, k = np.unique(codes(ids, base)[position], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(k, pa.int64())], ["lang", "code", "n"])

    table = sample.where("NOT held_back").mapInArrow(grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names, code, n = np.array(table["lang"].to_pylist(), object), table["code"].to_numpy(), table["n"].to_numpy()
    langs = sorted(set(names))
    if not langs:
        return None
    tops = {}
    for lang in langs:
        where = np.flatnonzero(names == lang)
        order = np.argsort(code[where])
        tops[lang] = (code[where][order], n[where][order])
    model = Model(alphabet, langs, tops)
    held = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        m = held.value
        for b in batches:
            for at, size in _slices(b.column("text")):
                langs = b.column("lang").slice(at, size).to_pylist()
                own = np.array([m.langs.index(x) if x in tops_of else -1 for x in langs])
                h, n = m.entropies(b.column("text").slice(at, size).to_pylist(), lut)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n, pa.int64()), pa.array(h[np.arange(len(own)), own])], ["own", "n", "h"])

    tops_of = set(tops)
    seen = sample.where("held_back").mapInArrow(measure, "own int, n long, h double").where("own >= 0").toArrow()  # three numbers a row of the bounded sample
    model.calibrate(*(seen[c].to_numpy() for c in ("own", "n", "h")))
    return model


def _slices(texts: pa.Array):
    """(start, rows) of runs of rows with at most about ``SLICE`` bytes, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, stop - at
        at = stop


def predict(docs: DataFrame, model: Model | None, keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score, entropy and rejected, their names after ``prefix``."""
    added = [prefix + c for c in ("lang_pred", "score", "entropy", "rejected")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = "text" if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else "__text"

    def run(batches):
        m = held.value
        lut = numbering(m.alphabet) if m else None
        for b in batches:
            texts = b.column(source)
            for at, size in _slices(texts):
                part = texts.slice(at, size).to_pylist()
                if m:
                    names, score, entropy, rejected = m.predict(part, lut)
                else:
                    names, score, entropy, rejected = ["und"] * len(part), np.zeros(len(part)), np.full(len(part), np.nan), np.ones(len(part), bool)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(at, len(part)) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)],
                    [*keep, *added],
                )

    picked = docs.select(*keep) if source == "text" else docs.select(*keep, F.col("text").cast("string").alias(source))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    kinds = ", ".join(f"`{c}` {k}" for c, k in zip(added, ("string", "double", "double", "boolean")))
    return picked.mapInArrow(run, f"{kept}, {kinds}")


def held_out() -> Column:
    """The fold that no training sees: CRC-32 of the id as text, remainder 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every row, by a model of the folds that aren't held out."""
    sample = materialize(training_sample(docs, ~held_out(), per_lang=per_lang), "lang-sample")
    tagged = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(tagged, train(sample), ["doc_id", "held_out"])


def confident(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with its own columns."""
    sample = materialize(training_sample(docs, ~held_out(), per_lang=per_lang), "lang-sample")
    told = predict(docs, train(sample), docs.columns, prefix="__langid_")
    return told.where("NOT __langid_rejected").select(*docs.columns)
