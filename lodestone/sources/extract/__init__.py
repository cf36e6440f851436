"""Extractors by language. Each takes a file's text and a Sink, and never raises for what the text holds."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.sources.extract.base import Sink
from lodestone.sources.extract.c_family import extract_c, extract_cpp
from lodestone.sources.extract.csharp import extract_csharp
from lodestone.sources.extract.ecma import extract_javascript, extract_typescript
from lodestone.sources.extract.golang import extract_go
from lodestone.sources.extract.java import extract_java
from lodestone.sources.extract.python import extract_python
from lodestone.sources.extract.rust import extract_rust

Extractor = Callable[[str, Sink], None]
EXTRACTORS: dict[str, Extractor] = {
    "c": extract_c, "cpp": extract_cpp, "python": extract_python, "java": extract_java, "javascript": extract_javascript, "typescript": extract_typescript, "tsx": extract_typescript,
    "rust": extract_rust, "go": extract_go, "csharp": extract_csharp,
}


def register(language: str, extractor: Extractor) -> None:
    """Adds or replaces a language's extractor in this process; an index call takes the registry of the driver along."""
    EXTRACTORS[language] = extractor


def extract(path: str, language: str, text: str, extractors: dict[str, Extractor] | None = None) -> tuple[list[tuple], str]:
    """Rows of a file in order, the File symbol first, and how it went: ok, or the error after which the rest is missing."""
    sink = Sink(path)
    extractor = (extractors or EXTRACTORS).get(language)
    if extractor is None:
        return sink.rows, "no extractor"
    try:
        extractor(text, sink)
    except (IndexError, KeyError, RecursionError, ValueError) as error:
        return sink.rows, f"{type(error).__name__}: {error}"[:200]
    return sink.rows, "ok"
