"""Domain normalisation: registered domains, block lists, redirects, safe URLs."""

from __future__ import annotations

import os
import string
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions import fixed
from leadflow.functions.tables import Key, first_per_key, key_columns, look_up
from leadflow.functions.text import any_of, bare_host, col, first_filled, host_of, one_of, or_blank, strip


#: where systems keep the Public Suffix List (Mozilla Public License 2.0, publicsuffix.org)
SUFFIX_FILES = ("/usr/share/publicsuffix/public_suffix_list.dat", "/usr/share/publicsuffix/effective_tld_names.dat")


@lru_cache(maxsize=4)
def read_suffix_file(path: str, private: bool = False) -> tuple[str, ...]:
    """Rules of a Public Suffix List file, as written and in their ASCII form; registry rules unless ``private``."""
    rules: set[str] = set()
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if "===BEGIN PRIVATE DOMAINS===" in line and not private:
                break
            rule = line.split("//")[0].strip().lower()
            if rule:
                mark = "!" if rule.startswith("!") else ""
                rules |= {rule, mark + rule.removeprefix("!").encode("idna").decode("ascii") if "*" not in rule else rule}
    return tuple(sorted(rules))


def public_suffixes() -> Iterable[str]:
    """The system's Public Suffix List; on a machine without one, a short list with any two-letter suffix."""
    for path in SUFFIX_FILES:
        if os.path.exists(path):
            return read_suffix_file(path)
    letters = string.ascii_lowercase
    countries = [a + b for a in letters for b in letters]
    seconds = [f"{s}.{cc}" for cc, names in fixed.SECOND_LEVELS.items() for s in names]
    return fixed.GENERIC_SUFFIXES + seconds + countries


def with_registered_domain(
    df: DataFrame, host: Column, out: str, suffixes: Iterable[str] | None = None
) -> DataFrame:
    """Add ``out``: one label plus the longest public suffix of ``host``; null when either is missing.

    ``suffixes`` are rules: a name, ``*.name`` for any label in front of it, ``!name`` for a name that such a
    rule does not cover. A set test per tail length: no join and no shuffle, however long the list is. The
    host and its tails are columns of their own, so each is computed once per row.
    """
    names: dict[int, list[str]] = {}
    stars: dict[int, list[str]] = {}
    exceptions: dict[int, list[str]] = {}
    for rule in set(suffixes if suffixes is not None else public_suffixes()):
        group = exceptions if rule.startswith("!") else stars if rule.startswith("*.") else names
        rule = rule.removeprefix("!").removeprefix("*.")
        group.setdefault(rule.count(".") + 1, []).append(rule)
    # user:password@, :port and closing dots never belong to the name
    host = strip(F.regexp_replace(host, r"^.*@|:[^@]*$|\.+$", ""))
    deepest = max([1, *names, *exceptions, *(d + 1 for d in stars)])
    tails = {f"_tail{n}": F.substring_index("_host", ".", -n) for n in range(1, deepest + 2)}

    def one_of_rules(group: dict[int, list[str]], depth: int) -> Column | None:
        if depth not in group:
            return None
        # one expression text: thousands of literals one by one would take seconds to plan
        rules = ", ".join("'" + r.replace("\\", "").replace("'", "") + "'" for r in sorted(group[depth]))
        return F.expr(f"_tail{depth} IN ({rules})")

    found = None
    for depth in sorted(exceptions):
        test, value = one_of_rules(exceptions, depth), F.col(f"_tail{depth}")
        found = F.when(test, value) if found is None else found.when(test, value)
    for depth in range(deepest, 0, -1):
        tail, whole = F.col(f"_tail{depth}"), F.col(f"_tail{depth + 1}")
        tests = [t for t in (one_of_rules(names, depth),) if t is not None]
        if depth - 1 in stars:
            tests.append(one_of_rules(stars, depth - 1) & (F.length(tail) > F.length(f"_tail{depth - 1}")))
        if not tests:
            continue
        # a host that is a suffix itself has no label in front and stops here
        value = F.when((F.length(whole) > F.length(tail)) & ~whole.startswith("."), whole)
        test = any_of(tests)
        found = F.when(test, value) if found is None else found.when(test, value)
    return df.withColumn("_host", host).withColumns(tails).withColumn(out, found).drop("_host", *tails)


def clean_domains(
    df: DataFrame, url_col: str, suffixes: Iterable[str] | None = None, out: str = "domain"
) -> DataFrame:
    """Add ``domain``: the registered domain of a raw URL or host, null when invalid."""
    return with_registered_domain(df, bare_host(url_col), out, suffixes)


def is_blocked(domain: str | Column) -> Column:
    return F.coalesce(col(domain).isin(fixed.BLOCKED_DOMAINS), F.lit(False))


def blocked_domains(df: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Add ``blocked`` for social and directory sites."""
    return df.withColumn("blocked", is_blocked(domain_col))


def normalize_domains(
    df: DataFrame, url_col: str, suffixes: Iterable[str] | None = None
) -> DataFrame:
    """Add ``domain``, ``blocked`` and ``error`` for a raw URL column."""
    return (
        clean_domains(df, url_col, suffixes, "_clean")
        .withColumn("_empty", strip(or_blank(url_col)) == "")
        .withColumn("blocked", ~F.col("_empty") & is_blocked("_clean"))
        .withColumn(
            "error",
            F.when(F.col("_empty"), "empty input")
            .when(F.col("_clean").isNull(), "invalid URL")
            .when(F.col("blocked"), F.concat(F.lit("blocked domain: "), F.col("_clean"))),
        )
        .withColumn("domain", F.when(F.col("error").isNull(), F.col("_clean")))
        .drop("_clean", "_empty")
    )


def normalize_with_redirects(
    rows: DataFrame, redirects: DataFrame, suffixes: Iterable[str] | None = None, key: Key = "row_index"
) -> DataFrame:
    """Outcome per row of ``verified_domain`` (else ``raw_domain``) after following redirects.

    ``redirects(domain, final_url)`` holds one answer per domain; the target is checked again and
    may turn out blocked or invalid. A missing answer keeps the domain.
    """
    plain = normalize_domains(
        rows.select(*key_columns(key), first_filled("verified_domain", "raw_domain").alias("_raw")), "_raw", suffixes
    ).drop("_raw")
    answered = first_per_key(redirects.select("domain", "final_url"), ["domain"], ["final_url"])
    targets = (
        clean_domains(answered, "final_url", suffixes, "_target")
        .filter(F.col("_target").isNotNull())
        .select("domain", "_target")
    )
    joined = look_up(plain, targets, "domain")
    moved = F.col("_target").isNotNull()
    blocked = moved & is_blocked("_target")
    return joined.select(
        *key_columns(key),
        F.when(blocked, None).when(moved, F.col("_target")).otherwise(F.col("domain")).alias("domain"),
        F.when(moved, blocked).otherwise(F.col("blocked")).alias("blocked"),
        F.when(blocked, F.concat(F.lit("blocked domain: "), F.col("_target")))
        .when(~moved, F.col("error"))
        .alias("error"),
    )


def apply_normalized(rows: DataFrame, outcomes: DataFrame, key: Key = "row_index") -> DataFrame:
    """Write the outcome into ``normalized_domain`` and ``status``; rows without a verified domain stay."""
    o = outcomes.select(
        *key_columns(key),
        F.col("domain").alias("_domain"),
        F.col("blocked").alias("_blocked"),
        F.col("error").alias("_error"),
    )
    eligible = F.coalesce(F.col("verified_domain") != "", F.lit(False))
    good = F.col("_error").isNull() & F.coalesce(F.col("_domain") != "", F.lit(False))
    blocked = F.coalesce(F.col("_blocked"), F.lit(False))
    return (
        rows.join(o, key_columns(key), "left")
        .withColumn(
            "normalized_domain",
            F.when(eligible & ~blocked & good, F.col("_domain")).otherwise(
                F.col("normalized_domain")
            ),
        )
        .withColumn(
            "status",
            F.when(~eligible, F.col("status"))
            .when(blocked, "blocked")
            .when(good, "normalized")
            .otherwise("failed"),
        )
        .drop("_domain", "_blocked", "_error")
    )


def add_host(df: DataFrame, url_col: str) -> DataFrame:
    """Add ``host``: the URL authority without ``www.``; case and port stay."""
    return df.withColumn("host", host_of(url_col))


def antibot_domains(df: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Add ``antibot``: the domain is a listed one or a subdomain of it."""
    return df.withColumn("antibot", is_antibot(domain_col))


def is_antibot(domain: str | Column) -> Column:
    return F.lower(or_blank(domain)).rlike(rf"^(?:.*\.)?(?:{one_of(fixed.ANTIBOT_DOMAINS)})$")


# Address ranges that are not globally reachable.
PRIVATE_ADDRESS = (
    r"^(?:0|10|127)\.\d+\.\d+\.\d+$|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.[02]\.|^192\.168\.|"
    r"^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:24\d|25[0-5])\.|"
    r"^::1?$|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:|^2001:db8:"
)


def is_private_address(ip: str | Column) -> Column:
    """Private, loopback or link-local IPv4 and IPv6 addresses; host names are none."""
    ip = F.lower(col(ip))
    return F.coalesce(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|:") & ip.rlike(PRIVATE_ADDRESS), F.lit(False))


def url_hostname(url: str | Column) -> Column:
    """Lower-case host name without user, port and brackets."""
    netloc = F.regexp_extract(or_blank(url), r"^[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    name = F.regexp_replace(netloc, r"^.*@", "")
    bracketed = F.regexp_extract(name, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(name.startswith("["), bracketed).otherwise(F.regexp_replace(name, ":.*$", "")))


def safe_urls(df: DataFrame, url_col: str, dns: DataFrame | None = None) -> DataFrame:
    """Keep URLs that may be fetched.

    ``dns(host, ip)`` is optional; a host with any private address is dropped, an unknown host passes.
    """
    host = url_hostname(url_col)
    http = F.lower(or_blank(url_col)).rlike(r"^[\x00-\x20]*https?://")
    kept = (
        df.withColumn("_host", host)
        .filter(http & (F.col("_host") != "") & ~F.col("_host").isin(fixed.INTERNAL_HOSTS))
        .filter(~is_private_address("_host"))
    )
    if dns is not None:
        unsafe = dns.filter(is_private_address("ip")).select(F.lower("host").alias("_host")).distinct()
        kept = kept.join(unsafe, "_host", "left_anti")
    return kept.drop("_host")


def validate_emails(df: DataFrame, email_col: str) -> DataFrame:
    """Keep well-formed addresses."""
    return df.filter(F.col(email_col).rlike(f"^{fixed.EMAIL_PATTERN}$"))
