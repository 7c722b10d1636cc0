"""Checks of a translated text against its source: each a rule, together an array of what fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markdown import heading_levels, strong_is_even, table_marks
from .protect import EMPHASIS, PREFIX, may_move, spans
from .text import let


def kept_values(text: Column, terms: Sequence[str] = ()) -> Column:
    """Protected values without terms and emphasis marks, which a translation may add."""
    return F.filter(spans(text), lambda v: ~v.isin(*EMPHASIS, *terms))


def failures(source: Column, translated: Column, terms: Sequence[str] = ()) -> Column:
    """Names of the rules that the translation breaks, in a fixed order; none if it is sound. Without either text none is broken, without one of them at least one is."""

    def made(v: Column) -> Column:
        def ordered(values: Column) -> Column:
            return F.filter(values, lambda x: ~may_move(x))

        rules = F.array(
            F.when(heading_levels(source) != heading_levels(translated), F.lit("headings")),
            F.when(table_marks(source) != table_marks(translated), F.lit("table marks")),
            F.when(translated.contains(PREFIX), F.lit("placeholder left")),
            F.when(~strong_is_even(translated), F.lit("strong marks unpaired")),
            F.when(F.sort_array(v["a"]) != F.sort_array(v["b"]), F.lit("protected values")),
            F.when(ordered(v["a"]) != ordered(v["b"]), F.lit("protected order")),
        )
        return F.filter(rules, lambda r: r.isNotNull())

    # A text given back as it was can only break the rules that look at it alone.
    alone = F.filter(F.array(F.when(translated.contains(PREFIX), F.lit("placeholder left")), F.when(~strong_is_even(translated), F.lit("strong marks unpaired"))), lambda r: r.isNotNull())
    return F.when(source == translated, alone).otherwise(let(F.struct(kept_values(source, terms).alias("a"), kept_values(translated, terms).alias("b")), made))


def structure_matches(source: Column, translated: Column) -> Column:
    return (heading_levels(source) == heading_levels(translated)) & (table_marks(source) == table_marks(translated))
