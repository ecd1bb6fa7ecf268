"""A lexer for brace languages and Python, and the tokens that clone detection compares."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Two-character operators that are one token.
OPERATORS = (":=", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "->", "=>")


class Token(NamedTuple):
    kind: str  # name, number, string, op
    text: str
    line: int


_PART = (
    r"(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"
    r"|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$]*)"
    r"|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + r"|\S)"
)
_BRACES = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|" + _PART, re.S)
_PYTHON = re.compile(r"(?P<skip>\s+|\#[^\n]*)|(?P<doc>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|" + _PART, re.S)


def lex(source: str, language: str) -> list[Token]:
    """Tokens without space and comments. Unterminated strings end at their line, or at the end of the text."""
    out, line = [], 1
    for m in (_PYTHON if language == "python" else _BRACES).finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind != "skip":
            out.append(Token("string" if kind == "doc" else kind, text, line))
        line += text.count("\n")
    return out


#: Words that weak normalisation keeps, and those that semantic normalisation folds into $CTRL.
KEYWORDS = {
    "go": (
        "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map",
        "package", "range", "return", "select", "struct", "switch", "type", "var",
    ),
    "python": (
        "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from",
        "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
    ),
    "javascript": (
        "async", "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export", "extends", "finally", "for",
        "function", "if", "import", "in", "instanceof", "let", "new", "of", "return", "static", "super", "switch", "this", "throw", "try", "typeof", "var", "void",
        "while", "with", "yield",
    ),
    "java": (
        "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double", "else", "enum", "extends",
        "final", "finally", "float", "for", "if", "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "package", "private", "protected",
        "public", "return", "short", "static", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void", "volatile", "while",
    ),
}
CONTROL = {
    "go": ("if", "else", "for", "switch", "case", "default", "select", "range", "break", "continue", "return", "goto", "fallthrough"),
    "python": ("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "break", "continue", "return", "yield", "raise"),
    "javascript": ("if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "throw", "try", "catch", "finally"),
    "java": ("if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "throw", "try", "catch", "finally"),
}


def normalise(t: Token, mode: str, language: str) -> str:
    """strict: as is; mild: literals as $STR and $NUM; weak: names as $ID too; semantic: control words as $CTRL too."""
    family = "javascript" if language == "typescript" else language
    if mode == "strict":
        return t.text
    if t.kind in ("string", "number"):
        return "$STR" if t.kind == "string" else "$NUM"
    if t.kind == "name" and mode in ("weak", "semantic"):
        if mode == "semantic" and t.text in CONTROL.get(family, ()):
            return "$CTRL"
        if t.text not in KEYWORDS.get(family, ()):
            return "$ID"
    return t.text
