"""Protected spans: what a translation must not touch, swapped for placeholders and back."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, gaps_and_matches, let, quoted

# The spans that are protected, in order of priority, and the placeholder's form.
URL = r"(?:https?://|mailto:)[^\s<>()。！？；，、\u3000-\u303f\u2018-\u201f\uff00-\uffef]+"
SPANS = (
    r"```[^\n]*\n.*?```|~~~[^\n]*\n.*?~~~",
    r"<!--.*?-->",
    r"(?<!\\)(?:\*\*|__)",
    r"!\[[^\]\n]*\]\([^\n)]*\)",
    r"\$\$.*?\$\$",
    r"\\\[.*?\\\]",
    r"\\\(.*?\\\)",
    r"(?<!\\)\$(?!\$)(?:[^$\n]++|(?<=\\)[$\n])*+(?<!\\)\$",
    r"`+[^`\n]*`+",
    r"(?<=\]\()[^)\n]+(?=\))",
    r"</?\s*[A-Za-z][^>]*>",
    r"&(?:[A-Za-z][A-Za-z0-9]+|#[0-9]+|#x[0-9A-Fa-f]+);",
    URL,
)
#: What a span can begin with, but for the destination of a link.
SPAN_STARTS = r"`~<*_!$\\&hm"
PREFIX = "__MDT_"
URL_SCHEMES = ("http://", "https://", "mailto:")
EMPHASIS = ("**", "__")


def term_pattern(term: str) -> str:
    """The term as it stands; next to an ASCII word character only where it doesn't itself begin or end with one."""
    word = "[A-Za-z0-9_]"

    def ascii_word(c: str) -> bool:
        return c.isascii() and (c.isalnum() or c == "_")

    return (f"(?<!{word})" if ascii_word(term[0]) else "") + quoted(term) + (f"(?!{word})" if ascii_word(term[-1]) else "")


def exactly(terms: Sequence[str]) -> str:
    """Any of the terms, whatever stands beside it."""
    return terms_pattern(terms, beside=False)


def terms_pattern(terms: Sequence[str], beside: bool = True) -> str:
    """Any of the terms, the longest that fits at a place: one pattern with a branch wherever terms part ways.

    A place is tried with the terms that begin as it does, not with all, so many terms cost what a few do. It matches
    what the terms' own patterns (``term_pattern``) match, the longest first. Without terms it matches nothing. ``beside``: mind
    the characters beside a term.
    """
    word = "[A-Za-z0-9_]"

    def ascii_word(c: str) -> bool:
        return beside and c.isascii() and (c.isalnum() or c == "_")

    def literal(text: str) -> str:
        return "".join(c if not c.isascii() or c.isalnum() else f"\\x{ord(c):02x}" for c in text)

    def rest(own: list[str], at: int) -> str:
        """A pattern for what follows the first ``at`` characters of the terms, which share these."""
        ends = own[0][at:] == ""
        branches = [(c, list(g)) for c, g in groupby(own[1:] if ends else own, key=lambda t: t[at])]
        made = []
        for _, group in branches:
            shared = commonprefix([group[0], group[-1]])
            made.append(literal(shared[at:]) + rest(group, len(shared)))
        if ends:
            made.append(f"(?!{word})" if ascii_word(own[0][-1]) else "")
        return made[0] if len(made) == 1 else f"(?:{'|'.join(made)})"

    own = sorted({t for t in terms if t})
    inner = [t for t in own if ascii_word(t[0])]
    outer = [t for t in own if not ascii_word(t[0])]
    parts = ([f"(?<!{word})(?=[{literal(''.join(sorted({t[0] for t in inner})))}]){rest(inner, 0)}"] if inner else []) + ([rest(outer, 0)] if outer else [])
    return "|".join(f"(?:{p})" for p in parts) or "(?!)"


def span_pattern(terms: Sequence[str] = ()) -> str:
    """All protected spans, and after them the terms, the longest first.

    Most places of a text begin no span: one look at the character there tells so, before the kinds are tried in turn.
    """
    kinds = rf"(?:(?=[{SPAN_STARTS}])|(?<=\]\())(?:{'|'.join(f'(?:{p})' for p in SPANS)})"
    return "(?sU)" + "|".join([kinds, *([f"(?:{terms_pattern(terms)})"] if any(terms) else [])])


def spans(text: Column, terms: Sequence[str] = ()) -> Column:
    """The protected values in order."""
    return found(text, span_pattern(terms))


def may_move(value: Column, terms: Sequence[str] = ()) -> Column:
    """Formulas, inline code and terms may change places; all else has to keep its order."""
    free = value.startswith("$") | value.startswith("\\[") | value.startswith("\\(") | (value.startswith("`") & ~value.startswith("```"))
    return free | value.rlike(f"(?sU)\\A(?:{terms_pattern(terms)})\\z") if any(terms) else free


def apart(text: Column, base: Column) -> Column:
    """The base, with as many X as it takes not to occur in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.concat(base, F.lit("(X*)")), F.lit(1)), lambda x: F.length(x))
    return F.when(text.contains(base), F.concat(base, F.repeat(F.lit("X"), F.array_max(runs) + 1))).otherwise(base)


def prefix_of(text: Column) -> Column:
    """The placeholder prefix: a digest of the text, made so long that it doesn't occur in it."""
    return apart(text, F.concat(F.lit(PREFIX), F.upper(F.substring(F.sha2(text, 256), 1, 10)), F.lit("_")))


def protect(text: Column, terms: Sequence[str] = ()) -> Column:
    """(text, prefix, replacements (placeholder, value, ordered)) of a text; null for null."""

    def made(x: Column) -> Column:
        prefix, pieces = x["prefix"], x["pieces"]

        def placeholder(i: Column) -> Column:
            digits = i.cast("string")
            return F.concat(prefix, F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")), F.lit("__"))

        swapped = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, placeholder(F.floor(i / 2).cast("int"))).otherwise(p)), "")
        values = F.filter(pieces, lambda p, i: i % 2 == 1)
        kept = F.transform(values, lambda m, i: F.struct(placeholder(i).alias("placeholder"), m.alias("value"), (~may_move(m, terms)).alias("ordered")))
        return F.struct(swapped.alias("text"), prefix.alias("prefix"), kept.alias("replacements"))

    return F.when(text.isNotNull(), let(F.struct(prefix_of(text).alias("prefix"), gaps_and_matches(text, span_pattern(terms)).alias("pieces")), made))


def restore(translated: Column, protected: Column) -> Column:
    """(text, error): the values put back. The error says which rule the placeholders break, null if none."""
    pattern = F.concat(protected["prefix"], F.lit(r"\d{5,}__"))
    kept = protected["replacements"]

    def made(x: Column) -> Column:
        seen, expected = x["seen"], x["expected"]
        # A placeholder's number is its place among those kept, so none is searched for.
        own = lambda p: F.get(kept, F.substring(p, F.length(protected["prefix"]) + 1, F.length(p) - F.length(protected["prefix"]) - 2).try_cast("int"))
        gaps = F.split(translated, pattern, F.lit(-1))
        text = F.array_join(F.zip_with(gaps, F.transform(seen, lambda p: own(p)["value"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
        fixed = F.transform(F.filter(kept, lambda r: r["ordered"]), lambda r: r["placeholder"])
        error = (
            F.when(seen == expected, F.lit(None).cast("string"))
            .when(F.sort_array(seen) != F.sort_array(expected), F.lit("placeholders changed, lost or repeated"))
            .when(F.filter(seen, lambda p: own(p)["ordered"]) != fixed, F.lit("ordered placeholders moved"))
        )
        return let(error, lambda error: F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error")))

    seen = F.regexp_extract_all(translated, pattern, F.lit(0))
    return let(F.struct(seen.alias("seen"), F.transform(kept, lambda r: r["placeholder"]).alias("expected")), made)
