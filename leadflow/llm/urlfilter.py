"""Judge URLs by a short rule list and, for the rest, by an exact cascade of Bloom filters over hosts.

Level 1 encodes the listed hosts. Over the complete set of the corpus's hosts some that are not listed pass
it; level 2 encodes those, level 3 the listed ones that pass level 2, and so on until no false positive is
left. The first level that rejects a host then decides: an odd one says not listed, an even one listed. The
answer is exact for every host of the corpus, and rows are judged by bit tests alone, without a join. Only
DataFrame functions run here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or an address without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls.

    ``rules`` holds (action, host/path); a rule fits its host and all subdomains where the path begins with
    the rule's. Of equally long ones block goes before allow.
    """
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


@dataclass(frozen=True)
class Level:
    words: Column
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * 64 + i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(self.words, (F.floor(p / 64) + 1).cast("int"))
            out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
        return out


def bloom_level(keys: DataFrame, n: int, bits_per_key: float, seed: int) -> Level:
    """Bits of ``keys`` as an array of longs, combined in the tasks before the shuffle."""
    n_words = max(1, math.ceil(n * bits_per_key / 64))
    shape = Level(F.lit(None), n_words * 64, max(1, round(bits_per_key * math.log(2))), seed)
    place = keys.select(F.explode(F.array(*shape.positions(F.col("key")))).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    set_bits = place.select(F.floor(F.col("p") / 64).cast("long").alias("w"), one.alias("b"))
    zeros = keys.sparkSession.range(n_words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = set_bits.unionByName(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    row = words.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("all")).select(F.col("all.b").alias("words"))
    return Level(written(row, "cascade-level").select("words").scalar(), shape.bits, shape.hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: str | Column) -> Column:
        """Whether a key of the universe is listed; exact. Keys outside it may be taken for either."""
        key = F.col(key) if isinstance(key, str) else key
        # a key that passes all levels belongs to what the last one encodes
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, max_bytes: int = 64 << 20) -> Cascade | None:
    """A cascade over ``universe`` (key, listed), which has each key once; None beyond ``max_bytes``.

    No key listed gives a cascade without levels, for which nothing is listed. Null keys are left out.
    """
    known = written(universe.filter("key IS NOT NULL").select("key", "listed"), "cascade-keys")
    n_in, n_out = known.agg(
        F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0)), F.coalesce(F.sum((~F.col("listed")).cast("long")), F.lit(0))
    ).first()
    levels: list[Level] = []
    inside, n_inside, outside = known.filter("listed"), n_in, known.filter("NOT listed")
    per_key = max(4.0, 1.44 * math.log2(max(2.0, n_out / max(1, n_in))))
    while n_inside:
        if (sum(level.bits for level in levels) + n_inside * per_key) / 8 > max_bytes:
            return None
        level = bloom_level(inside, n_inside, per_key, seed=len(levels))
        levels.append(level)
        passed = written(outside.filter(level.holds(F.col("key"))), "cascade-passed")
        inside, outside, n_inside, per_key = passed, inside, passed.count(), 4.0
    return Cascade(tuple(levels))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = (), *, url_col: str = "url",
    key_col: str = "key", max_bytes: int = 64 << 20,
) -> DataFrame:
    """The rows with host, path, rule and verdict (allow or block).

    The longest fitting rule decides, else the block list ``listed`` (hosts in ``key_col``). A null address or
    one without ``://`` has an empty host and path, which only the list can name. Nulls and repeats in the list
    are ignored, repeated rows are judged one by one, an empty table stays empty. Input columns named like the
    new ones are replaced, others stay. ``rules`` is a short policy; long lists belong in ``listed``.
    Beyond ``max_bytes`` of filters the hosts are looked up by a join instead.
    """
    host, path = url_parts(url_col)
    rows = pages.withColumns({"host": host, "path": path})
    block = listed.select(F.col(key_col).alias("key")).filter("key IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    universe = hosts.join(block, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    cascade = build_cascade(universe, max_bytes)
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    if cascade is None:
        rows = rows.join(block.withColumnsRenamed({"key": "host", "listed": "__listed"}), "host", "left")
        hit = F.coalesce("__listed", F.lit(False))
    else:
        hit = cascade.listed("host")
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(action, F.when(hit, "block").otherwise("allow"))}).drop("__listed")


def hosts_with_labels(pages: DataFrame, labels: Sequence[str], url_col: str = "url") -> DataFrame:
    """Hosts of the pages one of whose dot-separated labels is in ``labels``: a block list (key)."""
    host, _ = url_parts(url_col)
    hosts = pages.select(host.alias("key")).distinct()
    return hosts.filter(F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in labels])))
