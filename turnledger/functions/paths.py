"""Expressions over log-file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(uri: Column) -> Column:
    """Decoded file-system path of a percent-encoded ``_metadata.file_path``.

    A literal plus sign must survive URL decoding. The ``file:`` scheme is dropped so
    local paths read as paths; other schemes stay, they are part of the identity.
    """
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return local_path(decoded)


def local_path(path: Column) -> Column:
    """Drop a leading ``file:`` scheme (``file:/x`` and ``file:///x`` alike)."""
    return F.regexp_replace(path, "^file:/+", "/")


def file_stem(path: Column) -> Column:
    """File name without a trailing ``.jsonl``."""
    return F.regexp_extract(path, r"([^/]*?)(\.jsonl)?$", 1)


def project_from_path(path: Column) -> Column:
    """Project encoded in a log path: the folder below the last ``projects`` folder,
    otherwise the parent folder; a leading dash marks an encoded absolute path."""
    below = F.regexp_extract(path, r"^(?:.*/)?projects/([^/]*)", 1)
    has_projects = F.regexp_like(path, F.lit(r"(?:^|/)projects/"))
    parent = F.regexp_extract(path, r"(?:^|/)([^/]*)/[^/]*$", 1)
    folder = F.nullif(F.when(has_projects, below).otherwise(parent), F.lit(""))
    return F.when(folder.startswith("-"), F.translate(folder, "-", "/")).otherwise(folder)


def project_label(path: Column) -> Column:
    """Last path segment for display, the whole path when that is empty."""
    tail = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.coalesce(F.nullif(tail, F.lit("")), path)
