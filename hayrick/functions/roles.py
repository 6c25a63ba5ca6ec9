"""What a path says about a source file: its role and its language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles, in the order in which they are looked for.
ROLES = ("fixture", "generated", "test", "example", "production", "unknown")
# Directories and file names of roles (also valid in RE2).
FIXTURE_PLACES = r"(^|/)(fixtures?|testdata|__mocks__)(/|$)"
FIXTURE_NAMES = r"(?i)(^|/)(fixture|fixtures|conftest|mocks?)($|[._])"
GENERATED_PLACES = r"(^|/)(generated|_generated|gen)(/|$)"
GENERATED_NAMES = r"(\.g\.dart|\.pb\.go|_pb2\.py|\.generated\.ts|\.gen\.ts)$"
TEST_PLACES = r"(^|/)(tests?|__tests__|spec)(/|$)"
TEST_NAMES = r"^(test_[^/]+|[^/]+_test)\.(py|go|rs|ts|tsx|js|jsx|mjs|cjs)$|^(conftest)\.py$|^[^/]+\.(spec|test)\.(ts|tsx|js|jsx|mjs|cjs)$|^test\.py$"
EXAMPLE_PLACES = r"(^|/)(examples?|samples?)(/|$)"
EXAMPLE_NAMES = r"(?i)(^|/)(example|sample|demo)s?($|[._])"

# Languages by file suffix.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".php": "php",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
}


def source_role(path: Column) -> Column:
    """The first role, in the order above, whose directories or file names fit."""
    bare = F.regexp_replace(path, "^/+|/+$", "")
    name = F.regexp_extract(bare, "[^/]*$", 0)
    role = F.when(bare == "", "unknown")
    for what, places, names in (("fixture", FIXTURE_PLACES, FIXTURE_NAMES), ("generated", GENERATED_PLACES, GENERATED_NAMES), ("test", TEST_PLACES, TEST_NAMES), ("example", EXAMPLE_PLACES, EXAMPLE_NAMES)):
        role = role.when(bare.rlike(places) | name.rlike(names), what)
    return role.otherwise("production")


def is_test(role: Column) -> Column:
    return role.isin("test", "fixture")


def language_of(path: Column) -> Column:
    """By the suffix, whose case matters; null for others."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.regexp_extract(path, r"(\.[^./]+)$", 1))
