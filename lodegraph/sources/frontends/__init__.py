"""One frontend a language: ``read(path, bytes) -> Facts``. The mapping is what callers extend or replace."""

from lodegraph.sources.frontends import braces, matlab, python
from lodegraph.sources.frontends.base import Facts, Frontend

FRONTENDS: dict[str, Frontend] = {"python": python.read, "java": braces.java, "cpp": braces.cpp, "go": braces.go, "rust": braces.rust, "matlab": matlab.read}

__all__ = ["FRONTENDS", "Facts", "Frontend"]
