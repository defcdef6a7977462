"""Text and identifier expressions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with at most one inner apostrophe or hyphen part.
TOKEN = r"(?U)[^\W_]+(?:['’-][^\W_]+)?"
FRAMING_TOKEN = r"[a-z][a-z0-9'-]+"
#: Suffixes that the light stemmer strips, longest first.
SUFFIXES = ("ings", "edly", "ing", "ers", "ies", "ied", "est", "es", "ed", "er", "ly", "s")
INGEST_SEPARATOR, STAGE_SEPARATOR = "\x1f", "\x1e"


def canonical(c: Column) -> Column:
    """Runs of white space become one blank, ends are stripped. (NFKC comes before it: functions.udfs.nfkc.)"""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    """The key form of a text."""
    return F.lower(canonical(c))


def tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), 0), F.lower)


def stable_id(prefix: str, parts: Iterable[Column], separator: str = INGEST_SEPARATOR) -> Column:
    """prefix and the first 12 hex digits of the parts' SHA-256. Null parts count as empty, so that they can't shift the others."""
    joined = F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined.cast("binary"), 256), 1, 12))


def ids_id(prefix: str, ids: Column) -> Column:
    """stable_id() of a set of ids, whatever their order."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(ids), STAGE_SEPARATOR).cast("binary"), 256), 1, 12))


def stem(c: Column, suffixes: Iterable[str] = SUFFIXES, keep: int = 4) -> Column:
    """Without the first suffix that matches and leaves at least keep letters."""
    out = None
    for s in suffixes:
        where, cut = c.endswith(s) & (F.length(c) >= len(s) + keep), F.substring(c, F.lit(1), F.length(c) - len(s))
        out = F.when(where, cut) if out is None else out.when(where, cut)
    return out.otherwise(c)


def framing_terms(c: Column, stop: Iterable[str] = ()) -> Column:
    """Distinct stems of ASCII words of three letters or more, in their first order; stop words go before and after stemming."""
    # distinct words first: what follows is done once for each
    words = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(FRAMING_TOKEN), 0)), lambda w: F.regexp_replace(w, "^['-]+|['-]+$", ""))
    stopped = F.array(*[F.lit(s) for s in stop]).cast("array<string>")
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stopped, w))
    return F.array_distinct(F.filter(F.transform(words, lambda w: stem(w)), lambda w: ~F.array_contains(stopped, w)))


def matches_any(c: Column, phrases: Iterable[str]) -> Column:
    """Whether one of the phrases (regular expressions) occurs, in any case."""
    return F.coalesce(c, F.lit("")).rlike("(?i)" + "|".join(phrases))


def joined_text(*parts: Column) -> Column:
    """Stripped parts in lines of their own; blank ones are left out."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def excerpt(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[SRNG]([0-9a-f]{12}|[0-9]{4,})$"), F.lit(False))


def safe_url(c: Column, repository: str) -> Column:
    """An https address below the repository on its forge, without control characters, quotes, blanks or an @."""
    return F.coalesce(c.startswith(f"https://github.com/{repository}/") & ~c.rlike(r"[\x00-\x20\x7f\"'<>@\\]"), F.lit(False))
