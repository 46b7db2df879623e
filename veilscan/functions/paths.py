"""Path predicates: what to skip, and what counts as a test or documentation file."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that are never scanned.
EXCLUDED_DIRECTORIES = ["node_modules", ".git"]
EXCLUDED_EXTENSIONS = [
    ".exe", ".dll", ".so", ".dylib", ".bin", ".tar", ".gz", ".7z", ".rar", ".png", ".jpg", ".jpeg",
    ".gif", ".ico", ".webp", ".mp4", ".mp3", ".wav", ".avi", ".mov", ".woff", ".woff2", ".ttf",
    ".eot",
]
EXCLUDED_FILENAMES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "composer.lock"]
# Directories of tests, fixtures and examples.
TEST_DIRECTORIES = [
    "test", "tests", "__tests__", "fixture", "fixtures", "mock", "mocks", "__mocks__", "example",
    "examples",
]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)\z", 1))


def suffix(path: Column) -> Column:
    """Lower-case text after the last dot of the whole path (used to choose a reader)."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def in_excluded_directory(path: Column) -> Column:
    names = "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRECTORIES)
    return normalize_path(path).rlike(rf"(?:^|/)(?:{names})/")


def is_excluded_file(path: Column, scan_all_extensions: bool = False) -> Column:
    named = basename(normalize_path(path)).isin(EXCLUDED_FILENAMES)
    if scan_all_extensions:
        return named
    return named | extension(normalize_path(path)).isin(EXCLUDED_EXTENSIONS)


def check_glob(pattern: str) -> None:
    """Reject ignore patterns whose brackets or braces do not balance."""
    for opening, closing in ("[]", "{}"):
        depth = 0
        for char in pattern:
            depth += (char == opening) - (char == closing)
            if depth < 0:
                break
        if depth != 0:
            raise ValueError(f"Invalid glob pattern in ignore list: {pattern!r}")


def matches_ignore(path: Column, patterns: Iterable[str]) -> Column:
    """True when a path falls under one of the user's ignore patterns."""
    path = normalize_path(path)
    tests = []
    for pattern in patterns:
        if not pattern:
            continue
        check_glob(pattern)
        clean = pattern.removeprefix("**/").removesuffix("/**")
        if clean.startswith("*."):
            tests.append(path.endswith(clean[1:]))
        tests += [path == clean, path.startswith(clean + "/"), path.endswith("/" + clean),
                  path.contains("/" + clean + "/")]
    return any_of(tests)


def is_ignored_path(
    path: Column, ignore: Iterable[str] = (), scan_all_extensions: bool = False
) -> Column:
    return is_excluded_file(path, scan_all_extensions) | matches_ignore(path, ignore)


def escapes_root(path: Column) -> Column:
    """Absolute paths and paths that climb out of their root."""
    return normalize_path(path).rlike(r"(?:^|/)\.\.(?:/|\z)|^/|^[A-Za-z]:/")


def is_test_or_doc(path: Column) -> Column:
    low = F.lower(normalize_path(path))
    return (
        low.rlike(r"\.mdx?\z")
        | F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(d) for d in TEST_DIRECTORIES]))
        | low.rlike(r"\.(?:test|spec|fixture|mock)\.[^./]+\z")
    )
