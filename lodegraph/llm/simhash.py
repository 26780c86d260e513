"""SimHash near-duplicates: fingerprints of whole texts and exact links by tiled comparison.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats (all words
if fewer), XXH64 with seed 42 of each; a bit is set if it is set in over half the hashes. No word:
zero. Two fingerprints link when at most ``RADIUS`` bits differ; components are the closure of that.

Equal fingerprints are one to begin with, so copies cost nothing. Different ones are put in cells, then
sorted by cell and population count and cut into tiles of ``TILE`` rows, at every size of a cell alike. A
tile is compared whole, with exclusive-or and bit counts in numpy, with itself and the tiles after it that
hold a part of its last cell; where the population counts of two tiles differ beyond the radius, that
pair and all later ones of the cell are skipped. From a tile pair only a spanning forest of its links
comes out if there are more links than rows, which loses no connection.

Cells thin the tile pairs without losing one: fingerprints that link agree in at least one of
``RADIUS + 1`` blocks of their bits, so a cell is a block's number and value (4 x 16 bits). Where more
than ``FULL`` fingerprints share a cell, their other 48 bits are blocked once more (4 x 12) and, if need
be, the 36 that are left (4 x 9); a fingerprint has four cells at each of these levels, so its copies don't
grow with the table. A cell that is still full at the last level is streamed: no more of it is held
than lies within the radius of a population count.

Nulls and texts without words have fingerprint zero, linked like any other. An empty table gives an
empty result. Rows repeated under one doc_id each get a row; rows without a doc_id link like others, and a
component without any has component null. Other columns are ignored.

Scale: texts are read once and never shuffled; distinct fingerprints are, four times at the first level.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brief, id_and_text, materialize, parallelism, text_mark
from .components import connected_components

RADIUS = 3
TILE = 64
SHINGLE = 3
#: Fingerprints a cell at which it is blocked once more, and bits of a block at each level.
FULL = 4096
_BLOCKS = RADIUS + 1
_LEVELS = (16, 12, 9)
#: Rows compared at once.
_BUFFER = 1 << 16


def fingerprint(text: bytes) -> int:
    """Of one text in UTF-8."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space meant
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -SHINGLE])).tolist()
        shingles = map(joined.__getitem__, map(slice, starts, (ends[SHINGLE - 1 :] - 1).tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(starts))
    n = len(h)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in brief(batches):
            fps = np.fromiter((fingerprint(t or b"") for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(fps.view(np.int64))], ["doc_id", "mark", "fp"])

    return id_and_text(docs).withColumn("mark", text_mark()).mapInArrow(run, "doc_id long, mark long, fp long")


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links x - y those of a spanning forest."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    keep = []
    for k, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
        p, q = root(p), root(q)
        if p != q:
            parent[q] = p
            keep.append(k)
    return x[keep], y[keep]


def tile_links(cell: np.ndarray, pop: np.ndarray, fp: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """Links within cells, of rows in order of cell and population count; how many tile pairs were compared and how many skipped."""
    out, compared, skipped, n = [], 0, 0, len(fp)
    for i in range(0, n, TILE):
        stop = min(i + TILE, n)
        last, most = cell[stop - 1], int(pop[stop - 1])
        end = stop + int(np.searchsorted(cell[stop:], last, side="right"))  # of the tile's last cell
        for j in range(i, end, TILE):
            if j > i and int(pop[j]) - most > RADIUS:
                skipped += -(-(end - j) // TILE)
                break
            compared += 1
            two = slice(j, min(j + TILE, n))
            near = (np.bitwise_count(fp[i:stop, None] ^ fp[None, two]) <= RADIUS) & (cell[i:stop, None] == cell[None, two])
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(x):
                x, y = x + i, y + j
                out.append(_forest(x, y) if len(x) > 2 * TILE else (x, y))
    return out, compared, skipped


def _cells(level: int) -> list:
    """The cells of a row (cell, rest) at a level: number and value of each block of ``rest``, and the bits that are left."""
    bits = _LEVELS[level]
    mask = F.lit((1 << bits) - 1)
    out = []
    for k in range(_BLOCKS):
        value = F.shiftrightunsigned("rest", bits * k).bitwiseAND(mask)
        above = F.shiftrightunsigned(F.shiftrightunsigned("rest", bits * k), bits)  # in two steps: a shift by 64 is one by 0
        left = F.shiftleft(above, bits * k).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << bits * k) - 1)))
        cell = F.shiftleft("cell", bits + 2).bitwiseOR(F.lit(k << bits)).bitwiseOR(value)
        out.append(F.struct(cell.alias("cell"), left.alias("rest")))
    return out


def celled(distinct_fps: DataFrame) -> DataFrame:
    """(level, cell, fp): every fingerprint in its cells, blocked further where a cell is full. ``distinct_fps``: a written table of ``fp``."""
    rows = distinct_fps.select("fp", F.lit(0).cast("long").alias("cell"), F.col("fp").alias("rest"))
    out = None
    for level in range(len(_LEVELS)):
        rows = rows.select("fp", F.explode(F.array(*_cells(level))).alias("c")).select("fp", "c.cell", "c.rest")
        here = rows.select(F.lit(level).alias("level"), "cell", "fp")
        full = None
        if level + 1 < len(_LEVELS):
            full = materialize(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL).select("cell"), "full-cells")
            if not full.limit(1).count():
                full = None
        here = here if full is None else here.join(full, "cell", "left_anti").select("level", "cell", "fp")
        out = here if out is None else out.unionByName(here)
        if full is None:
            break
        rows = rows.join(full, "cell", "left_semi")
    return out


def links(distinct_fps: DataFrame) -> DataFrame:
    """(fa, fb): edges between different fingerprints whose closure is that of all links."""

    def emit(cell, pop, fp):
        found = tile_links(cell, pop, fp)[0]
        if found:
            x, y = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))], ["fa", "fb"])

    def run(batches):
        held, size, enough = [], 0, _BUFFER
        for b in batches:
            cell, fp = b.column("cell").to_numpy() * len(_LEVELS) + b.column("level").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            held.append((cell, np.bitwise_count(fp), fp))
            size += len(fp)
            if size < enough:
                continue
            cell, pop, fp = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield from emit(cell[:cut], pop[:cut], fp[:cut])
            else:  # one cell: what is within the radius of rows to come is kept, and compared once more
                yield from emit(cell, pop, fp)
                cut = int(np.searchsorted(pop, int(pop[-1]) - RADIUS))
            held, size = [(cell[cut:], pop[cut:], fp[cut:])], len(cell) - cut
            enough = max(_BUFFER, 2 * size)
        if size:
            yield from emit(*(np.concatenate(c) for c in zip(*held)))

    rows = celled(distinct_fps).repartition(parallelism(distinct_fps.sparkSession), "level", "cell")
    return rows.sortWithinPartitions(F.col("cell") * len(_LEVELS) + F.col("level"), F.bit_count("fp"), "fp").mapInArrow(run, "fa long, fb long").distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp, and of its component the first row (component_id, component_mark), for every row."""
    prints = materialize(fingerprints(docs), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark")))
    reps = materialize(prints.groupBy("fp").agg(first.alias("first")), "fingerprints")
    members = connected_components(links(reps.select("fp")).select(F.col("fa").alias("u"), F.col("fb").alias("v")))
    of_fp = reps.join(members, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    of_component = of_fp.groupBy("c").agg(F.min("first").alias("least"))
    of_fp = of_fp.select("fp", "c").join(of_component, "c").select("fp", F.col("least.id").alias("component_id"), F.col("least.mark").alias("component_mark"))
    return prints.join(of_fp, "fp").select("doc_id", "mark", "fp", "component_id", "component_mark")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, kept) for ``keep_decided``: of each component the smallest id stays; of rows that share it or have none, the first by ``mark``."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("component_mark"))
    return components(docs).select("doc_id", "mark", first.alias("kept"))
