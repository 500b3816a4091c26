"""URLs as Column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(url: Column) -> Column:
    """The path of an absolute URL; '/' where it is empty, null for anything else."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+([^?#]*)", 1)
    absolute = url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+")
    return F.when(absolute, F.when(path == "", "/").otherwise(path))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1))
    return F.when(host != "", host)


def origin_of(url: Column) -> Column:
    origin = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+)", 1))
    return F.when(origin != "", origin)


def segments(url: Column) -> Column:
    """The non-empty parts of the path; an empty array where there is no URL."""
    return F.coalesce(F.array_remove(F.split(path_of(url), "/"), ""), F.array().cast("array<string>"))


def depth(url: Column) -> Column:
    return F.size(segments(url))


def canonical(url: Column) -> Column:
    """Origin and path with single slashes and one at the end; query and fragment go. Other texts stay."""
    parts = segments(url)
    path = F.when(F.size(parts) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")))
    return F.coalesce(F.concat(origin_of(url), path), url)


def without_parameter(url: Column, name: str) -> Column:
    """``url`` without one query parameter."""
    gone = F.regexp_replace(F.regexp_replace(url, rf"([?&]){name}=[^&#]*&?", "$1"), r"[?&](?=#|$)", "")
    return gone


def with_page(url: Column, page: Column, name: str) -> Column:
    """``url`` of the given page of a listing: page 1 has no parameter."""
    bare = without_parameter(url, name)
    base, fragment = F.regexp_extract(bare, r"^([^#]*)", 1), F.regexp_extract(bare, r"(#.*)?$", 1)
    joint = F.when(base.contains("?"), "&").otherwise("?")
    return F.when(page <= 1, bare).otherwise(F.concat(base, joint, F.lit(f"{name}="), page.cast("string"), fragment))


def leaf_key(url: Column, least: int = 6) -> Column:
    """Last path segment without .html, lower case; null below ``least`` characters."""
    leaf = F.lower(F.regexp_replace(F.try_element_at(segments(url), F.lit(-1)), r"(?i)\.html?$", ""))
    return F.when(F.length(leaf) >= least, leaf)


def page_slug(url: Column, default: str = "item") -> Column:
    """Last path segment without .htm, .html and .php."""
    last = F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit(default))
    bare = F.regexp_replace(F.regexp_replace(last, r"(?i)\.html?$", ""), r"(?i)\.php$", "")
    return F.when(bare == "", default).otherwise(bare)


def is_page(url: Column) -> Column:
    return F.coalesce(path_of(url).rlike(r"(?i)\.html?$"), F.lit(False))


def under_prefixes(path: Column, prefixes: list[str]) -> Column:
    """Whether a path equals one of the prefixes or lies below it."""
    bare = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    found = F.lit(False)
    for p in (p.strip().removesuffix("/") for p in prefixes):
        found = found | (bare == p) | bare.startswith(p + "/")
    return found


#: Path parts of pages that are not sections of a catalogue. Fixed values.
NOISE = ("brands", "blog", "statti", "about", "services", "personal", "auth", "reviews", "sales", "prices-info")


def is_noise(path: Column) -> Column:
    return path.rlike(r"(?i)/(?:tag|filter)/") | path.rlike(r"(?i)/apply/?$") | path.rlike(rf"(?i)/(?:{'|'.join(NOISE)})/")


def resolver(base: str, keep_failures: bool = False):
    """A function of a Column: the absolute URL of a reference. Anchors, scripts and empty
    references give null, or stay as they are with ``keep_failures``."""

    @F.pandas_udf("string")
    def resolved(refs: pd.Series) -> pd.Series:
        return refs.map(lambda r: resolve(r, base, keep_failures))

    return resolved


def resolve(ref: str | None, base: str, keep_failures: bool = False) -> str | None:
    if not ref or (not keep_failures and (ref == "#" or ref.startswith("javascript:"))):
        return None
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref if keep_failures else None
