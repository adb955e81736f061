"""Text functions as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of a URL that say nothing of what it names, or must not be kept.
_DROPPED = "^(utm_.*|ref|fbclid|gclid|v|cb|t|token|key|sig|signature|auth|access_token)$"
#: Patterns of keyword flags, bit by bit.
FLAGS = ("licen[sc]e", "https?://", "[0-9]{4}", "@", "token", "[a-z]!!")


def clean_text(t: Column) -> Column:
    """Code, links and mail addresses become a space; white space is one space; trimmed."""
    for pattern in ("`[^`]*`", r"https?://[^ \n]+", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", r"[ \t\n]+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(t)


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def grams(t: Column, n: int) -> Column:
    """The word n-grams of a text as 64-bit hashes, in order."""
    w = tokens(t)
    starts = F.sequence(F.lit(1), F.size(w) - n + 1)
    return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<bigint>"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host."""
    parts = F.split(host(url), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")


def normalize_url(url: Column) -> Column:
    """Scheme and host in small letters, no default port, fragment, tracking or secret parameters, nor slash at the end."""
    u = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([hH][tT][tT][pP][sS]?)://", 1))
    where = F.regexp_replace(F.lower(F.regexp_extract(u, "^[hH][tT][tT][pP][sS]?://([^/?]+)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[hH][tT][tT][pP][sS]?://[^/?]+([^?]*)", 1), "/+$", "")
    kept = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(_DROPPED))
    return F.concat(scheme, F.lit("://"), where, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
