"""Canonical form of an address written in many ways, as column expressions.

Set aside: white space and invisible signs anywhere, letter case in the whole address, escaping
(percent signs, JSON and HTML escapes), signs around the address (angle brackets, ``URL:``,
quotes, round brackets, a comma or semicolon behind it), empty path segments and ``.``, a slash, question
mark, ampersand or number sign with nothing behind it, the scheme's own port, dots behind the
host, and the order of query fields. Scheme, host, path segments, fields, values and a
non-empty fragment stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of the canonical form; addresses can't hold them, as control signs are removed.
_SEGMENT, _FIELD, _PART = "\x01", "\x02", "\x03"

# JSON and HTML escapes of signs that structure an address, after lower-casing.
_JSON = [("\\/", "/"), ("\\u0026", "&"), ("\\u003d", "="), ("\\u003f", "?"), ("\\u002f", "/"), ("\\u0023", "#"), ("\\u003a", ":"), ("\\u0025", "%"), ("\\u002b", "+")]
_HTML = [("&amp;", "&"), ("&#38;", "&"), ("&#x26;", "&"), ("&#61;", "="), ("&#x3d;", "="), ("&#47;", "/"), ("&#x2f;", "/"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")]


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _decoded(c: Column, plus_is_space: bool) -> Column:
    """Percent-decoded, lower case; as it is where the escapes are broken."""
    raw = c if plus_is_space else F.replace(c, F.lit("+"), F.lit("%2b"))
    needs = c.contains("%") | c.contains("+") if plus_is_space else c.contains("%")
    return F.when(needs, F.lower(F.coalesce(F.try_url_decode(raw), c))).otherwise(c)


def _stages(c: str):
    """The steps for a column; each is a projection of its own, so that nothing is computed twice."""
    x = F.col(c)
    yield {c: F.lower(F.regexp_replace(x, r"[\s\p{Z}\p{Cc}\p{Cf}]+", ""))}
    yield {c: F.when(x.contains("\\"), _swap(x, _JSON)).otherwise(x)}
    yield {c: F.when(x.contains("&"), _swap(x, _HTML)).otherwise(x)}
    yield {c: F.regexp_replace(x, r"""^[<("'\[{]*(?:url:)?[<("'\[{]*""", "")}
    # a closing bracket belongs to the address if it has the opening one
    around = """>]}"',;.#?&"""
    yield {c: F.when(x.contains("("), F.rtrim(x, F.lit(around))).otherwise(F.rtrim(x, F.lit(around + ")")))}
    head, scheme, host, path, query, fragment = (F.col(f"{c}_{k}") for k in ("head", "scheme", "host", "path", "query", "fragment"))
    yield {f"{c}_head": F.substring_index(x, "#", 1), f"{c}_fragment": F.when(x.contains("#"), F.regexp_extract(x, r"#(.*)$", 1)).otherwise("")}
    yield {
        f"{c}_scheme": F.regexp_extract(head, r"^([a-z][a-z0-9+.\-]*):", 1),
        f"{c}_head": F.regexp_replace(head, r"^(?:[a-z][a-z0-9+.\-]*:)?/*", ""),
    }
    yield {f"{c}_query": F.when(head.contains("?"), F.regexp_extract(head, r"\?(.*)$", 1)).otherwise(""), f"{c}_head": F.substring_index(head, "?", 1)}
    site = F.substring_index(head, "/", 1)
    bare = F.when(scheme == "http", F.regexp_replace(site, r":0*80$", "")).when(scheme == "https", F.regexp_replace(site, r":0*443$", "")).otherwise(site)
    yield {
        f"{c}_host": F.rtrim(F.rtrim(bare, F.lit(":")), F.lit(".")),
        f"{c}_path": F.filter(F.slice(F.split(head, "/"), 2, 1_000_000), lambda s: (s != "") & (s != ".")),
        f"{c}_query": F.filter(F.split(query, "&"), lambda s: s != ""),
        f"{c}_fragment": _decoded(fragment, False),
    }
    yield {
        f"{c}_path": F.when(x.contains("%"), F.transform(path, lambda s: _decoded(s, False))).otherwise(path),
        f"{c}_query": F.array_sort(F.when(x.rlike("[%+]"), F.transform(query, lambda s: _decoded(s, True))).otherwise(query)),
    }
    yield {
        c: F.concat(
            scheme, F.lit(_PART), host, F.lit(_PART), F.array_join(path, _SEGMENT), F.lit(_PART), F.array_join(query, _FIELD), F.lit(_PART), fragment
        )
    }


def with_canonical(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each address replaced by one text for all ways to write it; null stays null, and
    nothing but decoration becomes the address without any part."""
    for steps in zip(*(_stages(c) for c in columns)):
        df = df.withColumns({k: v for step in steps for k, v in step.items()})
    return df.drop(*(f"{c}_{k}" for c in columns for k in ("head", "scheme", "host", "path", "query", "fragment")))
