"""Identifiers and relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Last path segment without its final suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def numeric_id(path: Column, digits: int = 7) -> Column:
    """File stem, or null where it is not exactly ``digits`` decimal digits."""
    found = F.regexp_extract_all(file_name(path), F.lit(rf"^([0-9]{{{digits}}})(\.[^.]+)?$"), F.lit(1))
    return F.get(found, F.lit(0))


def is_relative_inside(path: Column) -> Column:
    """True for a dataset-relative path that cannot leave its root."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def fill_template(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders of a path template with columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def under_root(root: str, path: Column) -> Column:
    """Absolute form of a relative path below ``root``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), path)
