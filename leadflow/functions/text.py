"""Column helpers. Everything here stays inside Spark expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space when a cell is trimmed.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_PRINTING_ENDS = r"(?s)^[!-~](?:.*[!-~])?\z"
_SCHEME = r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks.

    A text whose ends are printing ASCII once blanks are off is done; the search through the list of
    characters, which costs most, is left to the others.
    """
    bare = F.trim(col(c))
    return F.when(bare.rlike(_PRINTING_ENDS), bare).otherwise(F.btrim(bare, F.lit(WHITE_SPACE)))


def not_blank(c: str | Column) -> Column:
    """What ``strip(c) != ""`` tells, from the left end alone."""
    return F.ltrim(col(c), F.lit(WHITE_SPACE)) != ""


def or_blank(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def filled(c: str | Column) -> Column:
    """True for a non-null, non-empty string; never null."""
    return F.coalesce(col(c) != "", F.lit(False))


def blank_to_null(c: str | Column) -> Column:
    return F.when(filled(c), col(c))


def first_filled(*cs: str | Column) -> Column:
    """First non-empty string, '' when there is none."""
    return F.coalesce(*[blank_to_null(c) for c in cs], F.lit(""))


def one_of(parts: list[str]) -> str:
    """Pattern that finds any of the given literal texts."""
    return "|".join(re.escape(p) for p in parts)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def host_of(url: str | Column) -> Column:
    """URL authority without a leading ``www.``; case and port stay; '' without ``//``."""
    netloc = F.regexp_extract(or_blank(url), r"^[\x00-\x20]*" + _SCHEME + r"//([^/?#]*)", 1)
    return F.regexp_replace(netloc, r"^www\.", "")


def url_scheme(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(or_blank(url), r"^[\x00-\x20]*([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def url_path(url: str | Column) -> Column:
    """Path of a URL, without query, fragment and the ``;params`` of its last segment."""
    path = F.regexp_extract(
        or_blank(url), r"^[\x00-\x20]*" + _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1
    )
    return F.regexp_replace(path, r";[^/]*$", "")


def bare_host(url: str | Column) -> Column:
    """Host as written: lower case, no scheme, no ``www.``, nothing after ``/ ? #``."""
    no_scheme = F.regexp_replace(F.lower(strip(or_blank(url))), r"^https?://", "")
    return F.regexp_extract(F.regexp_replace(no_scheme, r"^www\.", ""), r"^[^/?#]*", 0)


def sanitize(c: str | Column) -> Column:
    """Prefix a quote when a spreadsheet would read the cell as a formula."""
    c = col(c)
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def micros(c: str | Column) -> Column:
    """Microseconds since 1970, for zoned and plain timestamps (plain ones in the session zone)."""
    return F.unix_micros(col(c).cast("timestamp"))


def natural_key(c: str | Column) -> Column:
    """Sort key under which 'Row 9' comes before 'Row 10', whatever the number of digits."""
    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        size = F.lpad(F.length(digits).cast("string"), 6, "0")
        return F.when(run.rlike(r"^\d"), F.concat(size, digits)).otherwise(F.lower(run))

    runs = F.regexp_extract_all(or_blank(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, part), "")


def strict_json(body: str | Column) -> Column:
    """The text if all of it is one JSON document, else null: readers stop behind a first one without a word."""
    c = F.col(body) if isinstance(body, str) else body
    # beside a second element the document must be the whole first one
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit(",0]"))), "$", "array<variant>")
    return F.when(F.size(pair) == 2, c)
