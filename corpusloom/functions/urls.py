"""URL functions (survey F10-F12, P13)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# A scheme counts in front only; what stands behind the host but a slash stays.
_LEADING_SCHEME = r"^[a-z][a-z0-9+.-]*://"


def normalise_hosts(hosts: Iterable[str]) -> list[str]:
    """F10 on a driver list: each host once, by the rule of ``normalise_host``."""
    seen = dict.fromkeys(re.sub(_LEADING_SCHEME, "", h.lower()).removesuffix("/") for h in hosts)
    return sorted(seen)


def normalise_host(host: Column) -> Column:
    """F10 on a column: lower case, without one leading scheme and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), _LEADING_SCHEME, ""), "/$", "")


def url_host(url: Column) -> Column:
    """authority part, lower case, port kept; null when malformed."""
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def origin_tag(domain: Column) -> Column:
    """``cc:<domain>``."""
    return F.concat(F.lit("cc:"), domain)


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")


def split_bare(bare: Column) -> tuple[Column, Column]:
    """The host, lower case, and the rest from the first slash on, of a URL without its scheme."""
    host = F.split_part(bare, F.lit("/"), F.lit(1))
    return F.lower(host), F.substr(bare, F.length(host) + 1)


def wildcard_parts(domain: str, pattern: str = "*") -> tuple[str, str]:
    """LIKE texts for the host and the rest; a star in the host stays within the host."""
    escaped = f"{domain.strip()}/{pattern}"
    for sign in ("\\", "%", "_"):
        escaped = escaped.replace(sign, "\\" + sign)
    host, rest = escaped.replace("*", "%").split("/", 1)
    return host.lower(), "/" + rest


def wildcard_columns(domain: Column, pattern: Column) -> tuple[Column, Column]:
    """The same of two columns; a null pattern takes everything."""
    spelled = F.concat(F.trim(domain), F.lit("/"), F.coalesce(pattern, F.lit("*")))
    like = F.regexp_replace(F.regexp_replace(spelled, r"([\\%_])", r"\\$1"), r"\*", "%")
    return split_bare(like)


def matches_wildcard(url: Column, domain: str, pattern: str = "*") -> Column:
    """The URL without its scheme matches ``domain/pattern``."""
    host, rest = split_bare(without_scheme(url))
    host_like, rest_like = wildcard_parts(domain, pattern)
    return host.like(host_like) & rest.like(rest_like)


def literal_suffix(domain: Column) -> Column:
    """The labels behind the last one with a star of a host pattern; may be empty."""
    host = F.split_part(F.lower(F.trim(domain)), F.lit("/"), F.lit(1))
    return F.regexp_replace(host, r"^.*\*[^.]*\.?", "")


def host_suffixes(host: Column) -> Column:
    """The host, what remains of it label by label, and the empty text."""
    labels = F.split(host, r"\.")
    each = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.array_append(each, F.lit(""))
