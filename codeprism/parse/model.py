"""What every parser returns for a file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Parsed:
    #: (name, kind, start_line, end_line, exported)
    symbols: list[tuple[str, str, int, int, bool]] = field(default_factory=list)
    #: (path, alias, names, line)
    imports: list[tuple[str, str | None, list[str], int]] = field(default_factory=list)
    #: (name, line)
    refs: list[tuple[str, int]] = field(default_factory=list)
    #: (name, start_line, end_line, cyclomatic, cognitive, max_nesting)
    functions: list[tuple[str, int, int, int, int, int]] = field(default_factory=list)
    #: line ranges of all functions, nested ones too
    spans: list[tuple[int, int]] = field(default_factory=list)
    error: str | None = None
