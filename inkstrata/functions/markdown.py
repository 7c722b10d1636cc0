"""Column functions over Markdown: blocks, headings, tables, counts of structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BREAKS, EOL, GAP, IN_LINE, found, gaps_and_matches, is_blank, let, places, running, strip

# Patterns and words that decide what is a heading, a table or an image.
HEADING = r"\A[ \t]*(#{1,6})[ \t]+([^\n]+?)[ \t]*(?:\n|\z)"
HEADING_LINE = r"(?md)^[ \t]*(#{1,6})[ \t]+"
REFERENCE_TITLES = ("references", "reference", "bibliography", "参考文献")
REFERENCE_TITLE_ZH = "参考文献"
CHINESE = ("zh", "zh-cn", "zh-hans")
HTML_TABLE = r"(?is)<table\b[^>]*>.*?</table>"
HTML_CAPTION = r"(?is)(<caption\b[^>]*>)(.*?)(</caption\s*>)"
MARKDOWN_IMAGE = r"!\[[^\]\n]*\]\((?:<[^>\n]+>|[^\s)]+)[^)\n]*\)"
HTML_IMAGE = r"(?i)<img\b[^>]*\bsrc\s*=\s*(?:\"[^\"]*\"|'[^']*')"
SEPARATOR = r"(?U)\A\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*\z"
TABLE_MARKS = ("<table", "</table>", "<tr", "</tr>", "<td", "</td>")
STRONG = r"(?<!\\)(?:\*\*|__)"
PUNCTUATION = "[!\\[\\]()\\s*_`#>|~:\\-–—.,;!?\"'’“”]+"

# A fence opens on any line that begins with three marks and is closed by a line of nothing but marks, of either kind.
_LINE_END = rf"(?:{EOL}|\z)"
_CLOSE = rf"{GAP}*+(?:`{{3,}}+|~{{3,}}+){GAP}*+{_LINE_END}"
_OPEN = rf"{GAP}*+(?:```|~~~)"
_FENCED = rf"{_OPEN}{IN_LINE}*+{_LINE_END}(?:(?!{_CLOSE})(?:{IN_LINE}*+{EOL}|{IN_LINE}++\z))*+(?:{_CLOSE})?+"
_PLAIN = rf"(?!{_OPEN}){GAP}*+[^\s\x1F{BREAKS}]{IN_LINE}*+{_LINE_END}"
_BLANK = rf"(?:{GAP}*+{EOL}|{GAP}++\z)"
BLOCK = rf"(?U)(?:{_FENCED}|{_PLAIN})++(?:{_BLANK})*+|(?:{_BLANK})++"


def blocks(c: Column) -> Column:
    """Blocks, each with the blank lines after it; put together they are the text.

    A blank line inside a fence ends nothing, and a fence that nothing closes goes on to the end.
    """
    return found(c, BLOCK)


def heading(block: Column) -> Column:
    """(level, title) of a block whose first line is a heading, else null."""
    title = strip(F.regexp_replace(F.regexp_extract(block, HEADING, 2), r"[ \t]+#+[ \t]*\z", ""))
    return F.when(block.rlike(HEADING), F.struct(F.length(F.regexp_extract(block, HEADING, 1)).alias("level"), title.alias("title")))


def is_reference_title(title: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(title), r"(?U)[^\w一-\u9fff]+", " "))
    return plain.isin(*REFERENCE_TITLES)


def with_reference_title(block: Column, target_language: str) -> Column:
    """The block with its heading's title in Chinese, if that is the target."""
    if target_language.lower() not in CHINESE:
        return block
    return F.regexp_replace(block, r"\A([ \t]*#{1,6}[ \t]+)[^\n]+?([ \t]*(?:\n|\z))", f"$1{REFERENCE_TITLE_ZH}$2")


def is_table_row(line: Column) -> Column:
    return line.contains("|") & ~is_blank(line)


def is_separator(line: Column) -> Column:
    """At least two cells of three or more dashes, each with a colon at either end or none."""
    return line.rlike(SEPARATOR)


def is_front_matter(block: Column, number: Column) -> Column:
    bare = strip(block)
    return (number == 0) & bare.startswith("---") & bare.endswith("---")


def has_language(block: Column) -> Column:
    """Whether anything but code, images, tags and punctuation is left."""
    bare = block.rlike(rf"(?U)[^{PUNCTUATION[1:-2]}\x1C-\x1F]")
    left = block
    for pattern in (r"(?s)```.*?```", r"(?s)~~~.*?~~~", MARKDOWN_IMAGE, HTML_IMAGE, r"</?\s*[A-Za-z][^>]*>", f"(?U){PUNCTUATION}"):
        left = F.regexp_replace(left, pattern, "")
    # Code, images and tags have one of these marks.
    return F.when(block.rlike("[`~!<]"), ~is_blank(left)).otherwise(bare)


def heading_levels(text: Column) -> Column:
    """Levels of all heading lines in order."""
    return F.transform(found(text, HEADING_LINE, 1), lambda x: F.length(x))


def table_marks(text: Column) -> Column:
    """How often each tag of HTML tables occurs."""
    low = F.lower(text)
    return F.array(*[F.regexp_count(low, F.lit(m)) for m in TABLE_MARKS])


def strong_is_even(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\*\*")) % 2 == 0


def captions_of_table(table: Column) -> Column:
    """What the captions of an HTML table say."""
    return found(table, HTML_CAPTION, 2)


def has_html_table(text: Column) -> Column:
    """Whether a table is opened, in letters of any case."""
    return text.contains("<") & text.rlike("(?i)<table")


SPANS = "array<struct<start:int,stop:int>>"


def _places(text: Column, pattern: str) -> Column:
    return F.transform(places(text, pattern), lambda p: F.struct(p["start"], p["stop"]))


def _merged(spans: Column) -> Column:
    """Spans in order as one where they overlap: a span opens one if it starts at or after the end of all before it."""

    def by_ends(own: Column) -> Column:
        ends = running(F.transform(own, lambda s: s["stop"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def opened(ends: Column) -> Column:
            opens = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.get(own, i)["start"] >= F.get(ends, i))

            def closed(opens: Column) -> Column:
                stop = lambda k: F.get(ends, F.coalesce(F.get(opens, k + 1), F.size(own)))
                return F.transform(opens, lambda i, k: F.struct(F.get(own, i)["start"].alias("start"), stop(k).alias("stop")))

            return let(opens, closed)

        return let(ends, opened)

    return let(F.sort_array(spans), by_ends)


def table_spans(text: Column) -> Column:
    """(start, stop) of HTML and pipe tables, 0-based characters in order, merged where they overlap.

    A pipe table is a row, a separator, and the rows that follow.
    """
    none = F.array().cast(SPANS)
    html = F.when(has_html_table(text), _places(text, HTML_TABLE)).otherwise(none)
    pipe = F.when(text.contains("|"), _places(text, PIPE_TABLE)).otherwise(none)

    def made(x: Column) -> Column:
        return F.when(F.size(x["pipe"]) == 0, x["html"]).when(F.size(x["html"]) == 0, x["pipe"]).otherwise(_merged(F.concat(x["html"], x["pipe"])))

    return F.when(text.isNotNull(), let(F.struct(html.alias("html"), pipe.alias("pipe")), made))


def pieces_at(text: Column, spans: Column) -> Column:
    """What lies before the first span, the span, and so on in turn, to what lies after the last."""

    def pair(s: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["stop"])
        return F.array(F.substring(text, before + 1, s["start"] - before), F.substring(text, s["start"] + 1, s["stop"] - s["start"]))

    rest = F.substring(text, F.coalesce(F.get(spans, F.size(spans) - 1)["stop"], F.lit(0)) + 1, F.length(text))
    return F.concat(F.flatten(F.transform(spans, pair)), F.array(rest))


def table_pieces(text: Column) -> Column:
    """Prose and tables (those of ``table_spans``) in turn, prose first and last; put together they are the text."""
    html, pipe = has_html_table(text), text.contains("|")
    both = let(table_spans(text), lambda s: pieces_at(text, s))
    # A text that can have tables of one kind alone is cut by their pattern, without places.
    return F.when(html & pipe, both).when(html, gaps_and_matches(text, HTML_TABLE)).when(pipe, gaps_and_matches(text, PIPE_TABLE)).when(text.isNotNull(), F.array(text))


_ROW = rf"(?=(?:[ -{{}}~]++|[^|{BREAKS}])*+\|){IN_LINE}*+(?:{EOL}|\z)"
_RULE = rf"(?={GAP}*\|?{GAP}*:?-{{3,}}:?{GAP}*(?:\|{GAP}*:?-{{3,}}:?{GAP}*)+\|?{GAP}*(?:{EOL}|\z)){_ROW}"
_AT_LINE = r"(?:(?<=[" + BREAKS + r"])|\A)(?<!\r(?=\n))"
PIPE_TABLE = rf"(?U){_AT_LINE}{_ROW}{_RULE}(?:{_ROW})*+"


def table_segments(text: Column) -> Column:
    """(text, translatable) pieces in order: prose and the words of captions are, table bodies aren't."""
    kind = "array<struct<text:string,translatable:boolean>>"

    def cut(p: Column) -> Column:
        table = p["text"]
        whole = F.array(F.struct(table.alias("text"), p["prose"].alias("translatable")))
        gaps, heads, words, tails = F.split(table, HTML_CAPTION, -1), found(table, HTML_CAPTION, 1), found(table, HTML_CAPTION, 2), found(table, HTML_CAPTION, 3)
        inner = F.transform(
            gaps,
            lambda g, i: F.array(
                F.struct(g.alias("text"), F.lit(False).alias("translatable")),
                F.struct(F.get(heads, i).alias("text"), F.lit(False).alias("translatable")),
                F.struct(F.get(words, i).alias("text"), F.lit(True).alias("translatable")),
                F.struct(F.get(tails, i).alias("text"), F.lit(False).alias("translatable")),
            ),
        )
        is_html = ~p["prose"] & F.lower(F.ltrim(table)).startswith("<table")
        return F.when(is_html, F.flatten(inner).cast(kind)).otherwise(whole.cast(kind))

    def pieces(edges: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.substring(text, edges[i] + 1, edges[i + 1] - edges[i]).alias("text"), (i % 2 == 0).alias("prose")))

    edges = let(table_spans(text), lambda s: F.concat(F.array(F.lit(0)), F.flatten(F.transform(s, lambda x: F.array(x["start"], x["stop"]))), F.array(F.length(text))))
    parts = F.filter(F.flatten(F.transform(let(edges, pieces), cut)), lambda p: p["text"].isNotNull() & (p["text"] != ""))
    plain = F.array(F.struct(text.alias("text"), (~is_blank(text)).alias("translatable"))).cast(kind)
    split = F.transform(parts, lambda p: F.struct(p["text"].alias("text"), (p["translatable"] & ~is_blank(p["text"])).alias("translatable")))
    return F.when(text.contains("|") | has_html_table(text), split.cast(kind)).otherwise(plain)


def caption_openers(text: Column) -> Column:
    """Openers of figure and table captions as 图N： and 表N：.

    An explicit mark after the number makes a caption anywhere; a space does where the last
    line that isn't blank is an image or a panel label. Lines end at line feeds.
    """
    marked = F.regexp_replace(text, rf"(?Umd)^{_IN_LINE}*+{OPENER}{_IN_LINE}*+{OPENER_MARK}{_IN_LINE}*+", "$1$2：")
    before = rf"(^{_IN_LINE}*+(?:{IMAGE_LINE}{_IN_LINE}*+|{PANEL_LABEL}[^\n]*+)\n(?:[\s\x1C-\x1F]*\n)?)"
    return F.regexp_replace(marked, rf"(?Umd){before}{_IN_LINE}*+{OPENER}{_IN_LINE}++", "$1$2$3：")


_IN_LINE = r"[\s\x1C-\x1F&&[^\n]]"

# What opens a caption or stands before one.
IMAGE_LINE = r"!\[[^\]\n]*\]\([^)\n]+\)"
PANEL_LABEL = r"[（(][a-z][）)]"
OPENER = rf"(图|表){_IN_LINE}*+([0-9]++)"
OPENER_MARK = r"[.．。:：]"
