"""Find and mask personal data with DataFrame functions alone.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for account numbers, ranges for
addresses), and words beside a span adjust its score. Patterns are possessive and start at the bound of a run,
so they read a text once, whatever it holds. Places come from the lengths of matches and of the gaps between
them, since Spark's functions give no offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import let

SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_BLOCK = 256
_CUT = 2048
_NEAR = 40
_START = r"(?:\G|(?<!%s))"


def _always(match: Column) -> Column:
    return F.lit(True)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _parts_in_range(match: Column) -> Column:
    def part(p: Column) -> Column:
        return let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & F.coalesce(q.try_cast("int") <= 255, F.lit(False)))

    return F.forall(F.split(match, r"\."), part)


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def _mod_97(match: Column) -> Column:
    """The account number with its first four signs last, letters as 10 to 35, leaves 1 when divided by 97."""
    compact = F.replace(match, F.lit(" "), F.lit(""))
    turned = let(compact, lambda c: F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4)))
    signs = F.filter(F.split(turned, ""), lambda x: x != "")

    def step(rest: Column, sign: Column) -> Column:
        value = F.ascii(sign)
        return F.when(value < 65, (rest * 10 + value - 48) % 97).otherwise((rest * 100 + value - 55) % 97)

    return F.aggregate(signs, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what a text must hold for the pattern to be tried, the pattern, its check, the
    score of a confirmed span, words that raise it, and by how much. A base kind is kept at any score."""

    name: str
    hint: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    words: tuple[str, ...]
    lift: float = 0.3
    base: bool = True


# Patterns of the base kinds, in the order in which spans are listed
KINDS = (
    Kind("email", "@", _START % "[A-Za-z0-9._%+-]" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, 0.9, ("mail", "contact", "write"), 0.1),
    Kind("ip", r"[0-9]\.[0-9]", _START % "[0-9]" + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _parts_in_range, 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6, ("tel", "phone", "call", "mobile", "fax")),
    Kind(
        "iban", "[A-Z]{2}[0-9]{2}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
        _mod_97, 0.7, ("iban", "account", "bank", "konto"), base=False,
    ),
    Kind(
        "ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        _always, 0.3, ("ssn", "social security", "social-security"), 0.5, base=False,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match in code points: sums of lengths, by blocks, so that long lists stay cheap."""
    lengths = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m")))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x["g"] + x["m"])

    def of(all_lengths: Column) -> Column:
        last = F.floor(F.size(all_lengths) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(all_lengths, b * _BLOCK + 1, F.lit(_BLOCK))))

        def with_blocks(sums: Column) -> Column:
            bases = F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0).cast("long"), lambda s, x: s + x))
            return let(bases, lambda base: F.transform(all_lengths, lambda x, i: start(base, x, i)))

        def start(base: Column, x: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return F.get(base, block) + total(F.slice(all_lengths, block * _BLOCK + 1, i % _BLOCK)) + x["g"]

        return let(blocks, with_blocks)

    return let(lengths, of)


def _spans(text: Column, kind: Kind, least: float) -> Column:
    near = r"(?i)(?<![a-z])(?:" + "|".join(kind.words) + r")"

    def made(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]

        def span(start: Column, i: Column) -> Column:
            match = F.get(found, i)
            beside = F.concat(F.right(F.get(gaps, i), F.lit(_NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(_NEAR)))
            lifted = F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.rlike(beside, F.lit(near)), kind.lift).otherwise(0.0))
            score = F.when(kind.check(match), lifted)
            return F.struct(
                F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(match)).cast("long").alias("end"), score.alias("score")
            )

        spans = F.transform(_starts(gaps, found), span)
        return F.filter(spans, lambda s: s["score"].isNotNull() if kind.base else s["score"] >= least)

    both = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("found"))
    hint = F.contains(text, F.lit(kind.hint)) if len(kind.hint) == 1 else F.rlike(text, F.lit(kind.hint))
    return F.when(hint, let(both, made)).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame, *, text_col: str = "text", out: str = "pii", kinds: Sequence[Kind] = KINDS, least: float = 0.6) -> DataFrame:
    """The rows with ``out``: spans (kind, start, end, score), by kind as in ``kinds``, then by start.

    Offsets are code points, ends exclusive. Kinds are searched apart, so spans of different kinds may overlap;
    a match that fails its check is dropped whole. Spans of kinds that are not base need a score of ``least``.
    A null or empty text has no spans. An input column called ``out`` is replaced, others stay; equal rows are
    read one by one; an empty table stays empty. Texts are read whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out, let(text, lambda t: F.concat(*[_spans(t, k, least) for k in kinds])))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _merged(spans: Column) -> Column:
    """Spans in order of start, those that overlap made one under the kind of the first.

    A span that starts behind the largest end before it begins a new one. Largest ends go by blocks, so that the work
    grows with the spans and not with their square.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    most = lambda part: F.coalesce(F.array_max(part), F.lit(0).cast("long"))

    def of(both: Column) -> Column:
        each, ends = both["o"], both["e"]
        last = F.floor(F.size(ends) / _BLOCK).cast("int")
        tops = F.transform(F.sequence(F.lit(0), last), lambda b: most(F.slice(ends, b * _BLOCK + 1, F.lit(_BLOCK))))
        bases = let(tops, lambda t: F.transform(t, lambda _, b: most(F.slice(t, F.lit(1), b))))

        def with_bases(base: Column) -> Column:
            def mark(s: Column, i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                before = F.greatest(F.get(base, block), most(F.slice(ends, block * _BLOCK + 1, i % _BLOCK)))
                return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before.alias("before"))

            heads = F.filter(F.transform(each, mark), lambda s: s["start"] >= s["before"])
            return let(heads, lambda h: F.transform(h, lambda s, k: F.struct(
                s["start"].alias("start"), F.coalesce(F.get(h, k + 1)["before"], most(ends)).alias("end"), s["kind"].alias("kind")
            )))

        return let(bases, with_bases)

    return let(ordered, lambda o: let(F.struct(o.alias("o"), F.transform(o, lambda s: s["end"]).alias("e")), of))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text that is given in blocks of ``_CUT`` characters: only those blocks are read."""
    def part(b: Column) -> Column:
        first = F.greatest(start - b * _CUT, F.lit(0))
        return F.substr(F.get(blocks, b.cast("int")), (first + 1).cast("int"), (F.least(end - b * _CUT, F.lit(_CUT)) - first).cast("int"))

    parts = F.sequence(F.floor(start / _CUT), F.floor((end - 1) / _CUT))
    return F.when(end > start, F.array_join(F.transform(parts, part), "")).otherwise("")


def mask_pii(docs: DataFrame, *, text_col: str = "text", kinds: Sequence[Kind] = KINDS, least: float = 0.6) -> DataFrame:
    """The rows with every span in the text replaced by its kind in angle brackets, as ``<EMAIL>``.

    Overlapping spans become one mask. Rows without spans stay as they are, null texts null. No row is dropped.
    """
    spans = "__pii"

    def masked(text: Column, blocks: Column, found: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            kept = _between(blocks, F.coalesce(F.get(found, i - 1)["end"], F.lit(0).cast("long")), s["start"])
            return F.concat(kept, F.lit("<"), F.upper(s["kind"]), F.lit(">"))

        tail = F.substr(text, (F.try_element_at(found, F.lit(-1))["end"] + 1).cast("int"))
        return F.concat(F.array_join(F.transform(found, piece), ""), tail)

    def in_blocks(text: Column) -> Column:
        last = F.floor(F.length(text) / _CUT).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.substr(text, b * _CUT + 1, F.lit(_CUT)))

    text = F.col(text_col)
    new = let(
        F.struct(text.alias("t"), in_blocks(text).alias("b"), _merged(F.col(spans)).alias("s")), lambda x: masked(x["t"], x["b"], x["s"])
    )
    found = find_pii(docs, text_col=text_col, out=spans, kinds=kinds, least=least)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, new).otherwise(text)).drop(spans)
