"""String functions over addresses and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlens.config import IMAGE_SUFFIXES


def canonical_url(url: Column) -> Column:
    """Trimmed, without query and fragment, without slashes at the end of the path, in lower case.

    An address without a path gets '/'. The whole query is dropped, so pages that differ
    only there fall together.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"(?s)[?#].*$", "")
    cut = F.regexp_replace(bare, r"/+$", "")
    return F.lower(F.regexp_replace(cut, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*)$", "$1/"))


def scheme(url: Column) -> Column:
    """Lower-case scheme, '' without one."""
    return F.lower(F.regexp_extract(F.trim(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port, '' without one."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def file_suffix(name: Column) -> Column:
    """The known image suffix a file name ends in, else ''."""
    known = "|".join(s[1:] for s in sorted(IMAGE_SUFFIXES, key=len, reverse=True))
    return F.regexp_extract(F.lower(name), rf"(\.(?:{known}))$", 1)


def fetch_route(url: Column) -> Column:
    """How an address is fetched: inline data, a corpus file, or the network."""
    s = scheme(url)
    return (
        F.when(s == "data", "data")
        .when((s == "corpus") | F.startswith(url, F.lit("/corpus/")), "corpus")
        .when(s.isin("http", "https"), "http")
        .otherwise("unsupported")
    )


def inside(path: Column, root: Column) -> Column:
    """Whether a normalised path lies in a folder; a sibling with the folder's name as prefix doesn't."""
    base = F.regexp_replace(root, r"/+$", "")
    return (path == base) | (F.startswith(path, F.concat(base, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)"))


def content_type_allowed(value: Column) -> Column:
    """Images and untyped bytes; no content type at all is allowed."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (v == "") | v.rlike(r"^(image/|application/octet-stream|binary/)")
