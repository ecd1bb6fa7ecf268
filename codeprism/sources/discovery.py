"""Scans of source trees: paths are judged before any content is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import EXTENSIONS, glob_regex, language_of
from ..operators.cicd import file_type

#: Folders that no scan enters, names and sizes that the security scan takes.
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", "__pycache__", ".mypy_cache", ".pytest_cache", "target", "dist", "build", ".venv", "venv")
MANIFESTS = (
    "go.mod", "go.sum", "requirements.txt", "pyproject.toml", "poetry.lock", "Cargo.lock", "Cargo.toml", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock",
    "pubspec.lock", "Gemfile.lock",
)
CONFIG_EXTENSIONS = ("env", "toml", "yaml", "yml", "json", "cfg", "ini", "conf", "properties")
MOST_BYTES = 10 * 1024 * 1024


class TreeReader(DataSourceReader):
    """A partition per entry of the root folder; a folder is walked where it is read."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.wanted = re.compile(options.get("wanted", ""))
        self.most = int(options.get("most_bytes", 1 << 62))
        self.whole = options.get("content", "true") == "true"

    def open(self):
        from pyarrow import fs

        uri = self.root if "://" in self.root else "file://" + self.root.removeprefix("file:")
        found, base = fs.FileSystem.from_uri(uri)
        return fs, found, base.rstrip("/")

    def partitions(self):
        fs, store, base = self.open()
        return [InputPartition(x.path) for x in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda x: x.path)]

    def read(self, partition):
        fs, store, base = self.open()
        todo = [store.get_file_info(partition.value)]
        while todo:
            x = todo.pop()
            if x.type == fs.FileType.Directory:
                if x.base_name not in SKIPPED_FOLDERS:
                    todo += store.get_file_info(fs.FileSelector(x.path, allow_not_found=True))
            elif x.type == fs.FileType.File:
                path = x.path[len(base) + 1 :]
                if x.size <= self.most and self.wanted.search(path):
                    try:
                        content = store.open_input_stream(x.path, compression=None).read() if self.whole else None
                    except OSError:  # gone or unreadable
                        continue
                    yield path, x.size, content


class TreeSource(DataSource):
    """``source_tree``: files of a folder with names that Spark's own file sources
    leave out (``.env``, ``__init__.py``). Options ``wanted`` (a pattern on the
    relative path), ``most_bytes`` and ``content`` are judged before content is read.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema):
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, root: str, wanted: str = "", most_bytes: int = 1 << 62) -> DataFrame:
    """path (relative), length, content of the readable files under ``root``, skipped folders aside."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("wanted", wanted).option("most_bytes", most_bytes).load(root)


_SOURCES = r"\.(" + "|".join(EXTENSIONS) + r")$"
_SECURITY = _SOURCES + r"|\.(" + "|".join(CONFIG_EXTENSIONS) + r")$|(^|/)(" + "|".join(map(re.escape, MANIFESTS)) + r")$|(^|/)\.env[^/]*$"
_CICD = r"(?i)\.ya?ml$|dockerfile|\.service$"


def text(content: str = "content"):
    """Bytes as text; what isn't UTF-8 is replaced."""
    return F.make_valid_utf8(F.col(content).cast("string"))


#: Files at a tree's root that name paths to ignore.
IGNORE_FILES = (".gitignore", ".codeprismignore")


def ignore_patterns(files: dict[str, str], configured: list[str] = ()) -> list[str]:
    """Patterns of the configuration, then of the ignore files (name -> text): a line each, without comments and blank lines."""
    lines = [x for name in IGNORE_FILES for x in files.get(name, "").split("\n")]
    return [*configured, *(x.strip() for x in lines if x.strip() and not x.startswith("#"))]


def load_ignore_patterns(root: str, configured: list[str] = ()) -> list[str]:
    """:func:`ignore_patterns` of the files under ``root``, on any store; a missing file has none."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    found = {}
    for name in IGNORE_FILES:
        path = f"{base.rstrip('/')}/{name}"
        if store.get_file_info(path).type == fs.FileType.File:
            found[name] = store.open_input_stream(path).read().decode("utf-8", "replace")
    return ignore_patterns(found, configured)


def not_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Paths that no pattern fits, as a glob or as a folder before them; a pattern that ends in ``/**`` fits what stands before it too."""
    for p in patterns:
        fits = F.col("path").rlike(glob_regex(p)) | F.col("path").rlike(glob_regex(p.rstrip("/") + "/**"))
        files = files.where(~fits & (F.col("path") != p.removesuffix("/**") if p.endswith("/**") else F.lit(True)))
    return files


def source_files(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """path, content, language of files in known languages that neither ``ignore`` nor the tree's ignore files name."""
    ignore = load_ignore_patterns(root, list(ignore))
    found = tree(spark, root, _SOURCES).withColumn("language", language_of("path")).where("language is not null")
    return not_ignored(found, list(ignore)).select("path", text().alias("content"), "language")


def security_files(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """Sources, manifests, configuration and environment files of 10 MiB at most, each path once."""
    found = not_ignored(tree(spark, root, _SECURITY, MOST_BYTES), list(ignore))
    return found.select("path", text().alias("content"), language_of("path").alias("language")).dropDuplicates(["path"])


def cicd_files(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """CI/CD configuration; ignore patterns are parts of a path here."""
    found = tree(spark, root, _CICD).withColumn("kind", file_type("path")).where("kind is not null")
    for p in ignore:
        found = found.where(~F.contains("path", F.lit(p)))
    return found.select("path", text().alias("content"), F.lit(None).cast("string").alias("language"))
