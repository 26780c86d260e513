"""Column expressions over source text and paths: lines, tokens, snippets, languages, path classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUFFIXES = {"cpp": ".c++ .cc .cpp .cxx .h .h++ .hh .hpp .hxx", "go": ".go", "java": ".java", "matlab": ".m", "python": ".py .pyi", "rust": ".rs"}
#: Suffix (lower case) -> language.
LANGUAGES = {suffix: language for language, held in _SUFFIXES.items() for suffix in held.split()}
GENERATED = ("auto-generated", "autogen", "gen", "generated")
VENDOR = ("external", "third-party", "third_party", "vendor", "vendors")
PRUNED = tuple(sorted(("node_modules", "__pycache__", "venv", "build", "dist", "out", "target", *(f".{x}" for x in ("git", "gradle", "idea", "lodegraph", "venv", "vscode")))))
_TEST_ENDS = ("test.cpp", "test.java", "tests.java", "_test.go", "_test.py", "_test.rs")


def line_count(text: Column) -> Column:
    """Line starts: offset 0 and every line feed but one at the very end; empty text has none."""
    return F.when(F.octet_length(text) == 0, F.lit(0)).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; empty text has none."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive) with their line feeds; null outside the text."""
    lines = F.split(text, "\n")
    inside = (start >= 1) & (end >= start) & (end <= line_count(text))
    body = F.array_join(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")), "\n")
    return F.when(inside, F.concat(body, F.when(end < F.size(lines), "\n").otherwise("")))


def snippet_with_context(text: Column, start: Column, end: Column, around: int) -> Column:
    """``snippet`` widened by ``around`` lines on both sides, clamped to the text."""
    inside = (start >= 1) & (end >= start) & (end <= line_count(text))
    return F.when(inside, snippet(text, F.greatest(start - around, F.lit(1)), F.least(end + around, line_count(text))))


def byte_range(content: Column, start: Column, end: Column) -> Column:
    """Bytes ``start`` to ``end`` (from 0, end exclusive) of binary content; null outside of it."""
    inside = (start >= 0) & (end >= start) & (end <= F.octet_length(content))
    return F.when(inside, F.substring(content, (start + 1).cast("int"), (end - start).cast("int")))


def language_of(path: Column) -> Column:
    """By the lower-cased suffix; null if it isn't one of ours."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), suffix)


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def is_test(path: Column) -> Column:
    """In a test directory below the top, or named like a test."""
    low = F.lower(path)
    name = F.element_at(_parts(low), -1)
    return any_of([F.contains(low, F.lit("/test/")), F.contains(low, F.lit("/tests/")), F.startswith(name, F.lit("test_")), *(F.endswith(name, F.lit(e)) for e in _TEST_ENDS)])


def has_component(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(_parts(F.lower(path)), F.array(*map(F.lit, names)))


def is_generated(path: Column) -> Column:
    return has_component(path, GENERATED) | F.endswith(F.lower(path), F.lit(".generated.java"))


def is_vendor(path: Column) -> Column:
    return has_component(path, VENDOR)


def is_pruned(path: Column) -> Column:
    """Whether some directory above the file is never entered."""
    above = F.slice(_parts(path), 1, F.greatest(F.size(_parts(path)) - 1, F.lit(0)))
    return F.exists(above, lambda d: d.isin(*PRUNED) | F.startswith(d, F.lit("bazel-")))


def scan_key(path: Column) -> Column:
    """Sort key of a walk that takes the files of a directory before its subdirectories, each in code point order."""
    parts = _parts(path)
    marked = F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p))
    return F.array_join(marked, "\x01")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
