"""Repairs of a translated text against its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markdown import STRONG
from .protect import URL, URL_SCHEMES, exactly, spans
from .text import SPACE, found, is_blank, let, strip, substitute

# An answer wrapped in a fence; characters that glue a word to a URL.
OUTER_FENCE = r"(?is)\A```(?:markdown|md|json)?\s*\n(.*)\n```\z"
URL_WORD = r"\A[A-Za-z0-9_一-\u9fff]"


def without_outer_fence(answer: Column) -> Column:
    """What a fence around the whole answer holds; other answers stay as they are."""
    bare = strip(answer)
    return F.when(bare.rlike(OUTER_FENCE), F.regexp_extract(bare, OUTER_FENCE, 1)).otherwise(answer)


def with_outer_space(source: Column, translated: Column) -> Column:
    """The translation between the white space that its source begins and ends with."""
    head = F.regexp_extract(source, rf"(?U)\A({SPACE}*+)", 1)
    tail = F.when(is_blank(source), F.lit("")).otherwise(F.regexp_extract(source, rf"(?U)({SPACE}*+)\z", 1))
    return F.concat(head, strip(translated), tail)


def without_code_terms(source: Column, translated: Column, terms: Sequence[str]) -> Column:
    """Terms without the code marks that the source doesn't have around them."""
    own = [t for t in terms if t and "`" not in t]
    if not own:
        return translated
    coded = rf"(?sU)(`+)({exactly(own)})\1"

    def bared(kept: Column) -> Column:
        def one(m: Column) -> Column:
            term = F.regexp_extract(m, coded, 2)
            return F.when(F.array_contains(kept, term), m).otherwise(term)

        return let(translated, lambda t: substitute(t, coded, one))

    return let(F.array_distinct(found(source, coded, 2)), bared)


def with_url_ends(source: Column, translated: Column) -> Column:
    """A space after a URL of the source that a word was glued to; the longest such URL counts.

    Found by halving the sorted URLs: between a prefix of a text and the text itself, all in order begin with that
    prefix, so the last URL not after a text is one, or leads to it over the longest URLs that it begins with.
    """
    urls = F.filter(spans(source), lambda v: v.startswith(URL_SCHEMES[0]) | v.startswith(URL_SCHEMES[1]) | v.startswith(URL_SCHEMES[2]))
    known = let(F.sort_array(F.array_distinct(urls)), with_parents)

    def made(known: Column) -> Column:
        def apart(token: Column) -> Column:
            return let(
                longest_prefix(known, token),
                lambda u: F.when(u.isNull() | (u == token), token)
                .when(F.substring(token, F.length(u) + 1, F.length(token)).rlike(URL_WORD), F.concat(u, F.lit(" "), F.substring(token, F.length(u) + 1, F.length(token))))
                .otherwise(token),
            )

        return substitute(translated, f"(?U){URL}", apart)

    return let(known, made)


def with_parents(urls: Column) -> Column:
    """(text, parents) of sorted, different texts: those before it that it begins with, the longest first."""
    kind = "array<struct<text:string,parents:array<string>>>"

    def step(acc: Column, u: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        chain = F.concat(F.array(last["text"]), last["parents"])
        return F.concat(acc, F.array(F.struct(u.alias("text"), F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.filter(chain, lambda p: u.startswith(p))).alias("parents"))).cast(kind))

    return F.aggregate(urls, F.array().cast(kind), step)


def longest_prefix(known: Column, text: Column) -> Column:
    """The longest of ``known`` (see ``with_parents``) that a text begins with, null if none does."""
    # As many halvings as any array takes; those after the last change nothing.
    span = F.struct(F.lit(-1).alias("low"), F.size(known).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(known, middle)["text"] <= text
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high")))

    rounds = F.ceil(F.log2(F.size(known) + 2)).cast("int")
    before = let(F.aggregate(F.sequence(F.lit(1), rounds), span, halve)["low"], lambda i: F.when(i >= 0, F.get(known, i)))
    return let(before, lambda b: F.when(text.startswith(b["text"]), b["text"]).otherwise(F.get(F.filter(b["parents"], lambda p: text.startswith(p)), 0)))


def with_strong_space(source: Column, translated: Column) -> Column:
    """White space beside strong marks as in the source, if both have as many marks."""

    def is_space(c: Column) -> Column:
        return (c != "") & is_blank(c)

    def made(s: Column) -> Column:
        def gap(g: Column, i: Column) -> Column:
            own, last = F.get(s, i), F.size(s) - 1
            first_s, last_s = F.left(own, F.lit(1)), F.right(own, F.lit(1))
            head = F.when((i > 0) & is_space(first_s) & ~is_blank(F.left(g, F.lit(1))), first_s).otherwise(F.lit(""))
            tail = F.when((i < last) & is_space(last_s) & ~is_blank(F.right(g, F.lit(1))), last_s).otherwise(F.lit(""))
            inner = F.when((i == 0) | (i == last), F.lit("")).when(is_space(last_s), last_s).when(is_space(first_s), first_s).otherwise(F.lit(""))
            return F.when(g == "", inner).otherwise(F.concat(head, g, tail))

        gaps = F.split(translated, STRONG, -1)
        marks = found(translated, STRONG)
        joined = F.array_join(F.zip_with(F.transform(gaps, gap), marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        return F.when(F.size(s) == F.size(gaps), joined).otherwise(translated)

    return let(F.split(source, STRONG, -1), made)


def cleaned(source: Column, translated: Column, terms: Sequence[str] = (), outer: bool = True) -> Column:
    """All repairs in their order: outer space, code marks, URL ends, strong marks."""
    out = with_outer_space(source, translated) if outer else translated
    out = without_code_terms(source, out, terms)
    return let(out, lambda x: let(with_url_ends(source, x), lambda y: with_strong_space(source, y)))
