"""Column functions over file paths."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import rules


def any_of(tests) -> Column:
    tests = list(tests)
    return reduce(or_, tests) if tests else F.lit(False)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty for none and for dot files."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def parent_module(path: Column) -> Column:
    """Directory of a file, NULL at the root."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def drop_root(path: Column) -> Column:
    """Remove the first path component (the archive's own folder)."""
    return F.regexp_replace(path, r"^[^/]*/", "")


def classify(ext: Column, kinds=None) -> Column:
    kinds = rules.KIND_EXTENSIONS if kinds is None else kinds
    out = F.lit(rules.OTHER_KIND)
    for kind, extensions in kinds.items():
        out = F.when(ext.isin(extensions), kind).otherwise(out)
    return out


def is_noise(path: Column) -> Column:
    """Licences, lock files, media, dot configuration, change logs."""
    name = F.lower(file_name(path))
    has_ext = file_name(path).rlike(r"^.+\.[^.]*$")
    norm_stem = F.replace(F.lower(stem(path)), F.lit("-"), F.lit("_"))
    tests = [
        name.isin(rules.NOISE_NAMES),
        ~has_ext & (name == "readme"),
        name.endswith(rules.NOISE_LOCK_SUFFIX),
        name.isin(rules.NOISE_LOCK_NAMES),
        F.lower(extension(path)).isin(rules.NOISE_EXTENSIONS),
    ]
    tests += [norm_stem.startswith(p) for p in rules.NOISE_STEM_PREFIXES]
    tests += [name.startswith(p) for p in rules.NOISE_NAME_PREFIXES]
    return F.coalesce(any_of(tests), F.lit(False))


def is_test_path(path: Column) -> Column:
    return any_of(path.contains(p) for p in rules.TEST_PATH_PARTS)


def is_doc_path(path: Column) -> Column:
    return any_of([path.endswith(s) for s in rules.DOC_PATH_SUFFIXES]
                  + [path.contains(p) for p in rules.DOC_PATH_PARTS])


def skip_as_orphan(name: Column, kind: Column) -> Column:
    """Symbols expected to have few connections: tests, main, constants, macros."""
    return (name.startswith("test_") | name.contains("_test") | (name == "main")
            | kind.isin("const", "static", "macro"))


def likely_exported(kind: Column, signature: Column) -> Column:
    return kind.isin("struct", "enum", "trait") | F.coalesce(signature.contains("pub "), F.lit(False))
