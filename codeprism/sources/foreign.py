"""Settings of this engine from the configuration of other tools, and notes on what has no counterpart."""

from __future__ import annotations

import configparser
import json
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Settings = dict[str, dict[str, object]]
#: Tool -> its file, and the other names that it goes by.
TOOLS = {"knip": ("knip.json", ()), "jscpd": (".jscpd.json", ()), "golangci-lint": (".golangci.yml", ("golangci",)), "ruff": ("ruff.toml", ()), "import-linter": (".importlinter", ("importlinter",))}
#: Linters of golangci-lint and the rules that they stand for.
LINTERS = (
    ("deadcode", "unused-function"), ("unused", "unused-function"), ("structcheck", "unused-type"), ("varcheck", "unused-type"), ("gocyclo", "high-cyclomatic"), ("cyclop", "high-cyclomatic"),
    ("gocognit", "high-cognitive"), ("dupl", "code-duplicate"), ("importorder", "import-boundary"),
)
#: Lines of jscpd count as so many tokens.
TOKENS_A_LINE = 10


def _strings(x: object) -> list[str]:
    return [v for v in x if isinstance(v, str)] if isinstance(x, list) else []


def _project(**lists: list[str]) -> dict[str, object]:
    return {k: v for k, v in lists.items() if v}


def knip(text: str) -> tuple[Settings, list[str]]:
    found, notes = json.loads(text), []
    if "ignoreDependencies" in found:
        notes.append("ignoreDependencies: taken as paths to ignore")
    if "workspaces" in found:
        notes.append("workspaces: to be reviewed by hand")
    known = ("entry", "ignore", "ignoreDependencies", "workspaces", "project")
    notes += [f"{k}: no counterpart" for k in found if k not in known]
    ignore = _strings(found.get("ignore")) + _strings(found.get("ignoreDependencies"))
    return {"project": _project(entry=_strings(found.get("entry")), ignore=ignore), "rules": {"unused-function": "error", "unused-import": "error", "unused-file": "warn"}}, notes


def jscpd(text: str) -> tuple[Settings, list[str]]:
    """Where both are set, the number of tokens goes before one worked out from lines."""
    found, notes, own = json.loads(text), [], {}
    whole = lambda k: found.get(k) if isinstance(found.get(k), int) and not isinstance(found.get(k), bool) and found[k] >= 0 else None
    if (lines := whole("minLines")) is not None:
        own["min-tokens"] = lines * TOKENS_A_LINE
        notes.append(f"minLines: taken as {lines * TOKENS_A_LINE} tokens")
    if (tokens := whole("minTokens")) is not None:
        own["min-tokens"] = tokens
    own["mode"] = "semantic" if "formatsExts" in found else "mild"
    notes += [f"{k}: no counterpart" for k in ("threshold", "reporters") if k in found]
    return {"project": _project(ignore=_strings(found.get("ignore"))), "duplication": own}, notes


def golangci_lint(text: str) -> tuple[Settings, list[str]]:
    import yaml

    skipped, enabled, limits = [], [], {}

    def walk(node: object) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                if k == "skip-dirs":
                    skipped.extend(f"{d}/**" for d in _strings(v))
                elif k == "enable":
                    enabled.extend(_strings(v))
                elif k in ("max-complexity", "min-complexity") and isinstance(v, int):
                    limits["max-cyclomatic"] = v
                elif k == "max-cognitive-complexity" and isinstance(v, int):
                    limits["max-cognitive"] = v
                walk(v)
        elif isinstance(node, list):
            for x in node:
                walk(x)

    walk(yaml.safe_load(text))
    rules = {rule: "error" for linter, rule in LINTERS if linter in enabled}
    notes = [f"{x}: no counterpart" for x in enabled if x not in dict(LINTERS)]
    return {"project": _project(ignore=skipped), "rules": rules, **({"health": limits} if limits else {}), "framework": {"go": []}}, notes


def ruff(text: str) -> tuple[Settings, list[str]]:
    """Of a file of its own, or of the tool's table in a project file."""
    found = tomllib.loads(text)
    found = found.get("tool", {}).get("ruff", found)
    lint = found.get("lint", found)
    select, rules = _strings(lint.get("select")), {}
    if any(s == "F" or s.startswith("F4") for s in select):
        rules |= {"unused-import": "error", "unused-function": "warn"}
    if any(s.startswith("C9") for s in select):
        rules["high-cyclomatic"] = "warn"
    notes = [f"{s}: no counterpart" for s in ("E", "I") if s in select] + (["line-length: no counterpart"] if "line-length" in found else [])
    most = lint.get("mccabe", {}).get("max-complexity")
    return {"project": _project(ignore=_strings(found.get("exclude"))), "rules": rules, **({"health": {"max-cyclomatic": most}} if isinstance(most, int) else {}), "framework": {"python": []}}, notes


def import_linter(text: str) -> tuple[Settings, list[str]]:
    """Layers become zones in which each may import what stands below it; forbidden modules are denied."""
    found = configparser.ConfigParser(delimiters=("=",), comment_prefixes=("#", ";"), interpolation=None, strict=False)
    found.read_string(text)
    arch, notes = {}, []
    listed = lambda v: [x.strip() for line in (v or "").split("\n") for x in line.split("|") if x.strip()]
    for section in found.sections():
        if not section.startswith("importlinter:contract:"):
            continue
        name, part = section.removeprefix("importlinter:contract:"), found[section]
        if part.get("type") == "layers":
            layers = listed(part.get("layers"))
            arch |= {f"zone.{x}": f"{x}/**" for x in layers}
            arch |= {f"allow.{x}.{y}": "" for i, x in enumerate(layers) for y in layers[i + 1 :]}
        elif part.get("type") == "forbidden":
            arch |= {f"deny.{x}.{y}": "" for x in listed(part.get("source_modules")) for y in listed(part.get("forbidden_modules"))}
            notes.append(f"{name}: taken as rules that deny")
        else:
            notes.append(f"{name}: contract type {part.get('type', 'unknown')} has no counterpart")
    return {"arch": arch, "framework": {"python": []}}, notes


CONVERTERS: dict[str, Callable[[str], tuple[Settings, list[str]]]] = {"knip": knip, "jscpd": jscpd, "golangci-lint": golangci_lint, "ruff": ruff, "import-linter": import_linter}


def tool_named(name: str) -> str:
    """The tool of a name in any case, or of another name that it goes by."""
    low = name.lower()
    for tool, (_, others) in TOOLS.items():
        if low == tool or low in others:
            return tool
    raise ValueError(f"unsupported tool: {name}")


def import_settings(tool: str, files: dict[str, str]) -> tuple[Settings, list[str]]:
    """Settings and notes from a tool's file among ``files`` (name -> text), or from the project file that may hold them.

    A file that isn't there or can't be parsed is a ValueError.
    """
    tool = tool_named(tool)
    name = TOOLS[tool][0]
    text = files.get(name)
    if text is None and tool == "ruff":
        text = files.get("pyproject.toml")
    if text is None and tool == "knip" and "knip" in (package := json.loads(files.get("package.json", "{}"))):
        text = json.dumps(package["knip"])
    if text is None:
        raise ValueError(f"no {name}")
    try:
        return CONVERTERS[tool](text)
    except (ValueError, configparser.Error) as e:
        raise ValueError(f"{name} can't be parsed: {e}") from e
    except Exception as e:  # the YAML reader has errors of its own
        if type(e).__module__.split(".")[0] == "yaml":
            raise ValueError(f"{name} can't be parsed: {e}") from e
        raise


def settings_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """section, key, value (as JSON) of settings."""
    return spark.createDataFrame([(s, k, json.dumps(v)) for s, part in settings.items() for k, v in part.items()], "section string, key string, value string")
