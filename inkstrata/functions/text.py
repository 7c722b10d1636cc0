"""Text helpers: white space, lines, and substitution with a function of the match."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line besides the pair of carriage return and line feed.
BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
EOL = rf"(?:\r\n|[{BREAKS}])"
#: A line's character, and with a quantifier after it, its rest: printable ASCII goes by one comparison, all else by the class.
IN_LINE = rf"(?:[ -~]++|[^{BREAKS}])"
#: White space within a line.
GAP = rf"[\s\x1F&&[^{BREAKS}]]"
SPACE = r"[\s\x1C-\x1F]"
FEW = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """What ``fold`` makes of the values before each, and of all of them: one entry more than ``values``.

    Blocks of about the square root of the number are folded first, so n values take n times that root, and nothing grows inside the fold.
    A few values (``FEW``) are folded one by one, where a growing array costs less than blocks do.
    """

    def by_block(values: Column, side: Column) -> Column:
        blocks = F.ceil(F.size(values) / side).cast("int")
        sums = F.transform(F.sequence(F.lit(1), blocks), lambda b: F.aggregate(F.slice(values, (b - 1) * side + 1, side), zero, fold))

        def spread(sums: Column) -> Column:
            starts = F.transform(F.sequence(F.lit(0), blocks), lambda b: F.aggregate(F.slice(sums, F.lit(1), b), zero, fold))
            return let(
                starts,
                lambda at: F.transform(
                    F.sequence(F.lit(0), F.size(values)), lambda i: F.aggregate(F.slice(values, F.floor(i / side).cast("int") * side + 1, i % side), F.get(at, F.floor(i / side).cast("int")), fold)
                ),
            )

        return let(sums, spread)

    def made(values: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
        few = F.aggregate(values, F.array(zero), lambda sums, v: F.concat(sums, F.array(fold(F.element_at(sums, -1), v))))
        return F.when(F.size(values) <= FEW, few).otherwise(let(side, lambda side: by_block(values, side)))

    return let(values, made)


def places(c: Column, pattern: str) -> Column:
    """(start, stop, match) of all matches, 0-based characters; the pattern runs once."""

    def made(pieces: Column) -> Column:
        at = running(F.transform(pieces, lambda p: F.length(p)), F.lit(0), lambda a, b: a + b)

        def spans(at: Column) -> Column:
            return F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), lambda hit, i: F.struct(F.get(at, 2 * i + 1).alias("start"), F.get(at, 2 * i + 2).alias("stop"), hit.alias("match")))

        return let(at, spans)

    return let(gaps_and_matches(c, pattern), made)


def paired(values: Column, others: Column) -> Column:
    """For each of the values the place (from 0) of its like among the others, the k-th of equal ones going with the k-th; null if there is none.

    Both are sorted as one, others first: a value stands as many places behind its like as there are others like it.
    """
    kind = lambda own, n: F.transform(own, lambda v, at: F.struct(v.alias("value"), F.lit(n).alias("kind"), at.alias("at")))

    def made(rows: Column) -> Column:
        first = F.transform(rows, lambda r, p: F.when((p > 0) & (F.get(rows, p - 1)["value"] == r["value"]), 0).otherwise(p))
        firsts = running(first, F.lit(0), lambda a, b: F.greatest(a, b))
        others_before = running(F.transform(rows, lambda r: 1 - r["kind"]), F.lit(0), lambda a, b: a + b)

        def like(x: Column) -> Column:
            def one(r: Column, p: Column) -> Column:
                it = F.get(rows, p - (F.get(x["before"], p) - F.get(x["before"], F.get(x["firsts"], p + 1))))
                return F.struct(r["kind"].alias("kind"), r["at"].alias("at"), F.when(it["kind"] == 0, it["at"]).alias("like"))

            return F.transform(F.filter(F.sort_array(F.transform(rows, one)), lambda r: r["kind"] == 1), lambda r: r["like"])

        return let(F.struct(firsts.alias("firsts"), others_before.alias("before")), like)

    return let(F.sort_array(F.concat(kind(others, 0), kind(values, 1))), made)


def strip(c: Column) -> Column:
    """Without white space (of all scripts) at either end."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}++|{SPACE}++\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"(?U)[^\s\x1C-\x1F]")


def lines(c: Column) -> Column:
    """Lines with their ends kept; put together they are the text. Empty text has none."""
    return found(c, rf"{IN_LINE}*+{EOL}|{IN_LINE}++")


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def gaps_and_matches(c: Column, pattern: str) -> Column:
    """What lies before the first match, the match, and so on in turn, to what lies after the last.

    The pattern runs once: it sets a control character around each match, at which the text is
    then split. A text that has that character itself is matched twice over instead.
    """
    mark = "\x01"
    once = F.split(F.regexp_replace(c, pattern, f"{mark}$0{mark}"), mark, -1)
    twice = F.flatten(F.zip_with(F.split(c, pattern, -1), found(c, pattern), lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    return F.when(c.contains(mark), twice).otherwise(once)


def substitute(c: Column, pattern: str, fn: Callable[..., Column]) -> Column:
    """Each match replaced by ``fn`` of it (and of its number, if ``fn`` takes two arguments); the pattern runs once.

    ``pattern`` must not match the empty text. ``c`` is named several times: use ``let`` where it is costly.
    """
    numbered = len(signature(fn).parameters) > 1

    def put(piece: Column, i: Column) -> Column:
        new = fn(piece, F.floor(i / 2).cast("int")) if numbered else fn(piece)
        return F.when(i % 2 == 1, F.coalesce(new, F.lit(""))).otherwise(piece)

    return F.array_join(F.transform(gaps_and_matches(c, pattern), put), "")


def quoted(literal: str) -> str:
    """A pattern for exactly this text."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}++", " "))


def percent_decode(c: Column) -> Column:
    """%xx as UTF-8 bytes; a plus stays one, and so does a per cent sign without two digits after it."""
    whole = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(whole)).otherwise(c)


def percent_encode(c: Column) -> Column:
    """Percent-encoded but for letters, digits and /:@-._~"""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike(r"[^A-Za-z0-9/:@\-._~]"), out).otherwise(c)


def redact(c: Column, secret: Column, keep: int = 600) -> Column:
    """A message's first ``keep`` characters on one line, with the secret blanked out before it is cut."""
    plain = F.when(secret != "", F.replace(c, secret, F.lit("<redacted>"))).otherwise(c)
    return F.left(collapse(plain), F.lit(keep))
