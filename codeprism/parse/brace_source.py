"""Go, JavaScript, TypeScript and Java: a structural scan over tokens.

No grammar: declarations, imports, names and control structures are told from
tokens and matched braces, which files that don't compile have too.
"""

from __future__ import annotations

from .lexer import KEYWORDS, Token, lex
from .model import Parsed

_OPEN, _CLOSE = "([{", ")]}"


def _partners(tokens: list[Token]) -> dict[int, int]:
    """Where each bracket closes; what stays open closes at the end."""
    out, stack = {}, []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "op" and t.text in _CLOSE and stack:
            out[stack.pop()] = i
    for i in stack:
        out[i] = len(tokens) - 1
    return out


def _block(tokens: list[Token], pairs: dict[int, int], i: int, end: int, header: bool = False) -> int | None:
    """The next ``{`` from ``i`` that isn't inside brackets; a ``;`` ends the search except in a ``header``."""
    while i < end:
        if tokens[i].kind == "op":
            if tokens[i].text == "{":
                return i
            if tokens[i].text in "([":
                i = pairs[i]
            elif tokens[i].text == "}" or tokens[i].text == ";" and not header:
                return None
        i += 1
    return None


def go_complexity(tokens: list[Token], pairs: dict[int, int], lo: int, hi: int) -> tuple[int, int, int]:
    """(cyclomatic, cognitive, max nesting) of the tokens of a Go function body.

    ``else if`` stands inside the ``if`` before it, so it nests further; cases
    of ``select`` don't count, ``default`` does.
    """
    cyc, cog, deep = 1, 0, 0
    closers: list[tuple[int, str]] = []  # (token where a structure ends, its kind)
    i = lo
    while i <= hi:
        while closers and closers[-1][0] < i:
            closers.pop()
        level = sum(kind != "select" for _, kind in closers)
        t = tokens[i]
        if t.kind == "name" and t.text in ("if", "for", "switch", "select"):
            start = _block(tokens, pairs, i + 1, hi + 1, True)
            end = pairs[start] if start is not None else i
            if t.text == "if":  # with all its else branches
                while end + 2 <= hi and tokens[end + 1].text == "else":
                    start = _block(tokens, pairs, end + 2, hi + 1, True)
                    if start is None:
                        break
                    end = pairs[start]
            closers.append((end, t.text))
            if t.text != "select":
                cyc += t.text in ("if", "for")
                cog += 1 + level
                deep = max(deep, level + 1)
        elif t.kind == "name" and t.text == "case" and not next((k == "select" for _, k in reversed(closers) if k in ("switch", "select")), False):
            cyc += 1
        elif t.kind == "name" and t.text == "default":
            cyc += 1
        elif t.text in ("&&", "||"):
            cyc, cog = cyc + 1, cog + 1
        i += 1
    return cyc, cog, deep


def parse_go(source: str) -> Parsed:
    out, tokens = Parsed(), lex(source, "go")
    pairs, i, n = _partners(tokens), 0, len(tokens)
    skip: set[int] = set()  # tokens that are definitions or stand in imports
    text = lambda k: tokens[k].text if k < n else ""
    while i < n:
        t = tokens[i]
        if t.kind == "op" and t.text in _OPEN:
            i = pairs[i] + 1
            continue
        if t.text == "import" and t.kind == "name":
            lo, hi = (i + 1, pairs[i + 1]) if text(i + 1) == "(" else (i + 1, min(n, i + 3))
            alias = None
            for k in range(lo, hi):
                if tokens[k].kind == "string":
                    out.imports.append((tokens[k].text.strip("\"`"), alias, [], tokens[k].line))
                    alias = None
                    skip.add(k)
                    if text(i + 1) != "(":
                        break
                elif tokens[k].kind == "name" or text(k) == ".":
                    alias = text(k)
                    skip.add(k)
            i = hi if text(i + 1) == "(" else i + 1
        elif t.text == "func" and t.kind == "name":
            k = i + 1
            if text(k) == "(":  # a receiver
                k = pairs[k] + 1
            if k < n and tokens[k].kind == "name":
                skip.add(k)
                body = _block(tokens, pairs, k + 1, n)
                end = pairs[body] if body is not None else k
                name = tokens[k].text
                out.symbols.append((name, "function", t.line, tokens[end].line, name[:1].isupper()))
                out.spans.append((t.line, tokens[end].line))
                if body is not None:
                    out.functions.append((name, t.line, tokens[end].line, *go_complexity(tokens, pairs, body + 1, end - 1)))
                i = end
        elif t.text == "type" and t.kind == "name":
            specs = [i + 1]
            end = i + 1
            if text(i + 1) == "(":
                end, specs, k = pairs[i + 1], [], i + 2
                while k < end:
                    specs.append(k)
                    line = tokens[k].line
                    while k < end and tokens[k].line == line:
                        if tokens[k].text in _OPEN:
                            k = pairs[k]
                            line = tokens[k].line
                        k += 1
            for k in specs:
                if k < n and tokens[k].kind == "name":
                    skip.add(k)
                    stop = _block(tokens, pairs, k + 1, next((j for j in range(k + 1, n) if tokens[j].line > tokens[k].line), n))
                    last = tokens[pairs[stop]].line if stop is not None else tokens[k].line
                    out.symbols.append((text(k), "type", tokens[k].line, last, text(k)[:1].isupper()))
            i = end
        i += 1
    words = set(KEYWORDS["go"])
    out.refs = [(t.text, t.line) for k, t in enumerate(tokens) if t.kind == "name" and k not in skip and t.text not in words]
    for k, t in enumerate(tokens):  # function literals
        if t.text == "func" and text(k + 1) == "(" and (body := _block(tokens, pairs, pairs[k + 1] + 1, n)) is not None and not any(s[0] == t.line for s in out.spans):
            out.spans.append((t.line, tokens[pairs[body]].line))
    return out


def parse_script(source: str, exported: bool = True) -> Parsed:
    """JavaScript and TypeScript. With ``exported`` false, declarations after
    ``export`` are left out and none counts as exported."""
    out, tokens = Parsed(), lex(source, "javascript")
    pairs, skip, n = _partners(tokens), set(), len(tokens)
    for i, t in enumerate(tokens):
        after = tokens[i - 1].text if i else ""
        if t.kind != "name":
            continue
        if t.text == "import":
            end = next((k for k in range(i + 1, n) if tokens[k].kind == "string"), None)
            if end is not None and (i + 1 == end or tokens[end - 1].text in ("from", "(")):
                names = [tokens[k].text for k in range(i + 1, end - 1) if tokens[k].kind == "name" and tokens[k].text not in ("as", "from", "type") and tokens[k + 1].text != "as"]
                out.imports.append((tokens[end].text.strip("\"'`"), None, names, t.line))
                skip.update(range(i, end + 1))
        elif t.text in ("function", "class") and i + 1 < n and tokens[i + 1].kind == "name" and i not in skip:
            k = i + 1
            skip.add(k)
            is_export = after == "export" or after in ("default", "async") and i > 1 and tokens[i - 2].text == "export"
            if is_export and not exported:
                continue
            body = _block(tokens, pairs, k + 1, n)
            end = tokens[pairs[body]].line if body is not None else t.line
            out.symbols.append((tokens[k].text, "function" if t.text == "function" else "type", t.line, end, is_export))
            if t.text == "function":
                out.spans.append((t.line, end))
    words = set(KEYWORDS["javascript"])
    out.refs = [(t.text, t.line) for k, t in enumerate(tokens) if t.kind == "name" and k not in skip and t.text not in words]
    return out


def parse_java(source: str, keep_static: bool = False) -> Parsed:
    """Types, methods and constructors; exported means public or protected.

    ``keep_static`` leaves the word in the path of static imports.
    """
    out, tokens = Parsed(), lex(source, "java")
    pairs, skip, n = _partners(tokens), set(), len(tokens)
    words = set(KEYWORDS["java"])

    def public(i: int) -> bool:
        k = i - 1
        while k >= 0 and tokens[k].text not in (";", "{", "}"):
            if tokens[k].text in ("public", "protected"):
                return True
            k -= 1
        return False

    kinds = {}
    for i, t in enumerate(tokens):
        if t.text == "import" and t.kind == "name":
            end = next((k for k in range(i + 1, n) if tokens[k].text == ";"), n)
            parts = [tokens[k].text for k in range(i + 1, end)]
            static = parts[:1] == ["static"]
            path = "".join(parts[1:] if static else parts)
            out.imports.append((("static " if static and keep_static else "") + path, None, [], t.line))
            skip.update(range(i, end))
        elif t.text in ("class", "interface", "enum", "record") and i + 1 < n and tokens[i + 1].kind == "name" and i not in skip and (not i or tokens[i - 1].text != "."):
            body = _block(tokens, pairs, i + 2, n)
            if body is None:
                continue
            skip.add(i + 1)
            kinds[body] = "type"
            out.symbols.append((tokens[i + 1].text, "type", t.line, tokens[pairs[body]].line, public(i)))
    inside = [b for b in kinds]
    for i, t in enumerate(tokens):
        if t.kind == "name" and t.text not in words and i + 1 < n and tokens[i + 1].text == "(" and i not in skip and (not i or tokens[i - 1].text not in (".", "new", "@", "return")):
            if not any(b < i < pairs[b] and not any(b < o < i < pairs[o] for o, p in pairs.items() if tokens[o].text == "{" and o != b and o not in kinds) for b in inside):
                continue
            body = _block(tokens, pairs, pairs[i + 1] + 1, n)
            if body is not None:
                skip.add(i)
                out.symbols.append((t.text, "function", t.line, tokens[pairs[body]].line, public(i)))
                out.spans.append((t.line, tokens[pairs[body]].line))
    out.refs = [(t.text, t.line) for k, t in enumerate(tokens) if t.kind == "name" and k not in skip and t.text not in words]
    return out
