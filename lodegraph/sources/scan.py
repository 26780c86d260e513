"""Scanning a working tree: walk, filters, classes, hashes and validation as columns over ``binaryFile`` rows."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.functions import text as tx
from lodegraph.sources import ignore

IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class ScanOptions:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    force_include: tuple[str, ...] = ()
    use_ignore_files: bool = True


def should_include(path: Column, options: ScanOptions, specs: list[tuple[str, list[ignore.Pattern]]]) -> Column:
    """Forced in; else out in a pruned directory, by an ignore file or by an exclusion; else in if inclusions agree or there are none."""
    included = ignore.matches(path, ignore.compile_lines(list(options.include))) if options.include else F.lit(True)
    return (
        F.when(ignore.matches(path, ignore.compile_lines(list(options.force_include))), True)
        .when(tx.is_pruned(path), False)
        .when(ignore.ignored(path, specs), False)
        .when(ignore.matches(path, ignore.compile_lines(list(options.exclude))), False)
        .otherwise(included)
    )


def load_ignore_files(root: str, options: ScanOptions) -> list[tuple[str, list[ignore.Pattern]]]:
    """(directory, patterns) of every ignore file in walk order; pruned directories count only if something may be forced in."""
    specs = []
    if not options.use_ignore_files:
        return specs
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if options.force_include or not (d in tx.PRUNED or d.startswith("bazel-")))
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        for name in sorted(set(names) & set(IGNORE_FILES)):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                specs.append(("" if base == "." else base, ignore.compile_lines(f.read().splitlines())))
    return specs


def describe(files: DataFrame) -> DataFrame:
    """(path, content) rows as file records; unsupported languages go. The walk's order is the column ``scan_key``."""
    path, content = F.col("path"), F.col("content")
    text = F.try_validate_utf8(content.cast("string"))
    newlines = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit("\n"))
    size = F.octet_length(content)
    ends = F.substring(content, size, F.lit(1)) == F.lit(b"\n")
    return files.withColumn("language", tx.language_of(path)).where("language IS NOT NULL").select(
        "path", "language", F.sha2(content, 256).alias("content_hash"), size.cast("long").alias("size_bytes"), F.when(size == 0, 0).otherwise(newlines + F.when(ends, 0).otherwise(1)).cast("long").alias("line_count"),
        tx.is_test(path).alias("is_test"), tx.is_generated(path).alias("is_generated"), tx.is_vendor(path).alias("is_vendor"), tx.scan_key(path).alias("scan_key"), text.isNotNull().alias("is_text"), "content",
    )


def _empty_files(spark: SparkSession, base: str) -> DataFrame:
    """Files without a byte, which the file source leaves out."""
    found = [os.path.relpath(p, base).replace(os.sep, "/") for folder, _, names in os.walk(base) for p in (os.path.join(folder, n) for n in names) if os.path.isfile(p) and not os.path.getsize(p)]
    return spark.createDataFrame([(p, b"") for p in found], "path string, content binary")


def scan(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """File records of a working tree on storage that the executors reach."""
    base = os.path.abspath(root).rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load("file://" + base)
    relative = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(base) + 1, 1 << 30)
    rows = rows.select(relative.alias("path"), "content").unionByName(_empty_files(spark, base)).where(should_include(F.col("path"), options, load_ignore_files(root, options)))
    return describe(rows)


def first_bad_byte(contents: Iterable[bytes]) -> list[tuple[str | None, int | None]]:
    """(code, offset) of what makes each content no source: a control byte, else broken UTF-8; (None, None) for sound ones."""
    out: list[tuple[str | None, int | None]] = []
    control = bytes(set(range(0x20)) - {0x09, 0x0A, 0x0C, 0x0D})
    keep = bytes(set(range(256)) - set(control))
    for c in contents:
        if c is None:
            out.append((None, None))
            continue
        bad = c.translate(None, keep)
        if bad:
            out.append(("binary_source", min(c.index(bytes([b])) for b in set(bad))))
            continue
        try:
            c.decode("utf-8")
            out.append((None, None))
        except UnicodeDecodeError as e:
            out.append(("invalid_utf8", e.start))
    return out


@F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("byte_offset", T.LongType())]))
def validate(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(first_bad_byte(contents), columns=["code", "byte_offset"]).astype({"byte_offset": "Int64"})
