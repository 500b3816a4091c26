"""Names of stored media files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "/api/media/"
#: File endings and content types of images. Fixed values.
ENDINGS = ("jpg", "jpeg", "png", "webp", "gif")
TYPES = {"jpeg": "jpg", "png": "png", "webp": "webp", "gif": "gif"}


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def ending(url: Column, content_type: Column | None = None) -> Column:
    """From the path, else from the content type, else bin; jpeg is jpg."""
    path = F.lower(F.regexp_extract(F.regexp_extract(url, "^([^?#]*)", 1), rf"(?i)\.({'|'.join(ENDINGS)})$", 1))
    kind = F.lit(None).cast("string")
    if content_type is not None:
        named = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
        for name, end in TYPES.items():
            kind = F.when(named.contains(name), end).otherwise(kind)
    found = F.coalesce(F.nullif(path, F.lit("")), kind, F.lit("bin"))
    return F.when(found == "jpeg", "jpg").otherwise(found)


def file_name(url: Column, content_type: Column | None = None) -> Column:
    return F.concat_ws(".", url_hash(url), ending(url, content_type))


def is_safe_name(name: Column) -> Column:
    return name.rlike(r"(?i)^[a-f0-9]{64}\.(?:jpe?g|png|webp|gif|bin)$")


def local_name(url: Column) -> Column:
    """The file of a local media URL, without query; null for other URLs and unsafe names."""
    name = F.substring_index(F.substring(url, len(PREFIX) + 1, 500), "?", 1)
    return F.when(url.startswith(PREFIX) & is_safe_name(name), name)


def is_external(url: Column) -> Column:
    return url.rlike("(?i)^https?://") & ~url.startswith(PREFIX)
