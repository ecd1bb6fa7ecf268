"""Tables of the engine, as Spark DDL."""

LOCATION = "struct<file: string, start_line: int, end_line: int, start_column: int, end_column: int>"
ACTIONS = "array<struct<description: string, auto_fixable: boolean, edits: array<struct<file: string, start_line: int, end_line: int, new_text: string>>>>"
#: The central fact table: what every rule returns.
FINDINGS = f"module_id string, rule_id string, message string, severity string, location {LOCATION}, confidence float, actions {ACTIONS}, metadata map<string, string>"

FILES = "path string, content string, language string"
TOKENS = "file string, pos int, text string, line int"
SYMBOLS = "name string, kind string, start_line int, end_line int, exported boolean, file string"
IMPORTS = "file string, path string, alias string, names array<string>, line int"
REFS = "name string, file string, line int"
SUPPRESSIONS = "file string, line int, rules array<string>, text string"
FUNCTION_METRICS = "name string, file string, start_line int, end_line int, cyclomatic int, cognitive int, lines int, max_nesting int"
FILE_HEALTH = "file string, score int, grade string, cyclomatic_penalty int, cognitive_penalty int, size_penalty int, nesting_penalty int"
BASELINE = "rule_id string, file string, start_line int, message string"
METRIC_POINTS = "seq bigint, name string, value double, labels map<string, string>, timestamp_ms bigint, provenance string"
SPANS = "name string, trace_id string, span_id string, parent_span_id string, start_time_ms bigint, end_time_ms bigint, attributes map<string, string>, status string, provenance string"
DEPS = "file string, name string, version string, line int"
VULNS = "package string, min_version string, max_version string, advisory string, description string, severity string"
FRAMEWORK_ENTRIES = "framework string, kind string, name string, file string, line int, confidence float"
LCOV_LINES = "path string, line int, hits bigint"
