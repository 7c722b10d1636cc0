"""Registered queries of rarer rules: kinds of places and spans, text lines beside crops, keys, symbols of listings."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import protect, pseudocode
from inkstrata.operators import figures, segment
from inkstrata.plans import translate
from inkstrata.plans.catalog import _content, _items, _rendered, _table
from inkstrata.plans.catalog_sql import LI

SEPARATORS = ("\n\n", ". ", "\n", " ")  # best place to split first
MIN_SIDE = 40


def split_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split at the best kind of place that they have, never inside a code span.

    The number of an order decides which kinds it may have at all.
    """
    q, order, line = F.col("l_quantity").cast("int"), F.col("l_orderkey"), F.col("l_linenumber")
    word = F.repeat(F.lit("w"), q)
    kind = F.greatest(order % 4, (F.floor(order / 4) + line) % 4).cast("int")
    coded = F.when(q % 4 == 0, F.concat(F.lit("`"), word, F.lit(" "), word, F.lit("`"))).otherwise(word)
    docs = _rendered(spark, sf_dir, F.concat(coded, F.get(F.array(*[F.lit(s) for s in SEPARATORS]), kind)))
    got = segment.halves(docs, min_side=MIN_SIDE)
    return got.select("doc_id", F.coalesce("split_at", F.lit(0)).cast("long").alias("split_at"), F.sha2(F.coalesce("right", F.lit("")), 256).alias("right_sha256"))


SPLIT_RANKS = f"""WITH {LI}, t AS (SELECT l_orderkey AS doc_id, i, repeat('w', l_quantity::INT) AS w, l_quantity::INT % 4 = 0 AS coded, greatest(l_orderkey % 4, (l_orderkey // 4 + l_linenumber) % 4)::INT AS kind FROM li),
x AS (SELECT doc_id, i, kind, CASE WHEN coded THEN '`' || w || ' ' || w || '`' ELSE w END || [chr(10) || chr(10), '. ', chr(10), ' '][kind + 1] AS piece, CASE kind WHEN 0 THEN 2 ELSE 1 END AS blank FROM t),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS p, sum(length(piece)) OVER (PARTITION BY doc_id) AS n, last_value(blank) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM x),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY kind, abs(p - n // 2), p) AS r FROM s WHERE p - blank >= {MIN_SIDE} AND n - tail - p >= {MIN_SIDE}),
d AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(p, 0)::BIGINT AS split_at, sha256(coalesce(substr(text, p::BIGINT + 1), '')) AS right_sha256 FROM d LEFT JOIN (SELECT * FROM k WHERE r = 1) k USING (doc_id)"""


#: One of each kind of protected span: how it stands in a text, the span, and whether it may change places.
KINDS = (
    ("```py\ncode x\n```", "```py\ncode x\n```", False),
    ("<!-- a\nb -->", "<!-- a\nb -->", False),
    ("**", "**", False),
    ("![a b](im/x.png)", "![a b](im/x.png)", False),
    ("$$a\n_b$$", "$$a\n_b$$", True),
    ("\\[x\ny\\]", "\\[x\ny\\]", True),
    ("\\(x\ny\\)", "\\(x\ny\\)", True),
    ("$a\\$b$", "$a\\$b$", True),
    ("`code x`", "`code x`", True),
    ("[name](see/x)", "see/x", False),
    ("<em class='x'>", "<em class='x'>", False),
    ("&#x2F;", "&#x2F;", False),
    ("https://a.org/x_y", "https://a.org/x_y", False),
)


def span_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two kinds around the words of each document, and escaped signs that open none."""
    stands = F.array(*[F.lit(k[0]) for k in KINDS])
    n = len(KINDS)
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z]+", " ")
    first, last = F.get(stands, (F.col("doc_id") % n).cast("int")), F.get(stands, (F.floor(F.col("doc_id") / n) % n).cast("int"))
    made = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", first, F.lit("\\$5"), words, F.lit("\\__"), last).alias("text"))
    kept = made.withColumn("kept", protect.protect(F.col("text"))["replacements"])
    return kept.select(
        "doc_id",
        F.array_join(F.transform("kept", lambda r: r["value"]), "|").alias("spans"),
        F.size(F.filter("kept", lambda r: ~r["ordered"])).cast("long").alias("n_free"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPAN_KINDS = f"""WITH k AS (SELECT unnest(range({len(KINDS)})) AS k, unnest([{", ".join(_quoted(k[1]) for k in KINDS)}]) AS v, unnest([{", ".join(str(k[2]).lower() for k in KINDS)}]) AS free)
SELECT doc_id, a.v || '|' || b.v AS spans, (a.free::INT + b.free::INT)::BIGINT AS n_free
FROM documents JOIN k a ON a.k = doc_id % {len(KINDS)} JOIN k b ON b.k = doc_id // {len(KINDS)} % {len(KINDS)}"""


def crop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops whose padded edges are drawn in off the text lines of their page."""
    content = _content(spark, sf_dir)
    sizes = content.select("doc_id", "page_idx").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    q, top = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 800
    wide = F.struct(F.lit(50.0).alias("x0"), (q * 1.75 + 236).alias("y0"), F.lit(550.0).alias("x1"), (q * 1.75 + 248).alias("y1"))
    tall = F.struct((q * 3 + 120).alias("x0"), (top - 10).alias("y0"), (q * 3 + 134).alias("x1"), (top + 90).alias("y1"))
    lines = _items(spark, sf_dir).where("i % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), F.floor(F.col("i") / 4).cast("int").alias("page_idx"), F.when(F.col("i") % 4 == 0, wide).otherwise(tall).alias("l"))
    plans = figures.crop_plans(figures.figure_groups(content), sizes, lines.select("doc_id", "page_idx", "l.*"))
    return plans.select("doc_id", F.col("figure").cast("long").alias("figure"), *[F.round(F.col("box")[e], 6).alias(e) for e in ("x0", "y0", "x1", "y1")])


def _drawn(before: str, name: str, line: int, low: str, high: str, a0: str, a1: str) -> str:
    """A step of the fold as a table: the edges of one direction drawn in off one line."""
    r = f"l[{line}]"
    down, up = f"greatest(u{high}, least({high}, {r}.{low} - 0.5))", f"least(u{low}, greatest({low}, {r}.{high} + 0.5))"
    cuts_high = f"({r}.{low} < {high} AND {high} < {r}.{high} AND {down} < {high} - 1e-9)"
    cuts_low = f"({r}.{low} < {low} AND {low} < {r}.{high} AND {up} > {low} + 1e-9)"
    free = f"len(l) < {line} OR {r}.{a1} <= {a0} OR {r}.{a0} >= {a1}"
    high_goes = cuts_high if low == "y0" else f"(NOT {cuts_low} AND {cuts_high})"
    low_goes = cuts_low if low == "x0" else f"(NOT {cuts_high} AND {cuts_low})"
    return f"{name} AS (SELECT * REPLACE (CASE WHEN {free} THEN {high} WHEN {high_goes} THEN {down} ELSE {high} END AS {high}, CASE WHEN {free} THEN {low} WHEN {low_goes} THEN {up} ELSE {low} END AS {low}) FROM {before})"


def _crop_lines() -> str:
    from inkstrata.plans.catalog_sql import CONTENT

    steps, before = [], "b"
    for turn in range(4):
        for low, high, a0, a1 in (("y0", "y1", "x0", "x1"), ("x0", "x1", "y0", "y1")):
            for line in (1, 2):
                steps.append(_drawn(before, f"s{len(steps)}", line, low, high, a0, a1))
                before = f"s{len(steps) - 1}"
    return f"""WITH {CONTENT}, r AS (SELECT l_orderkey AS doc_id, i // 4 AS page, CASE WHEN i % 4 = 0
  THEN {{'y0': l_quantity::DOUBLE * 1.75::DOUBLE + 236, 'x0': 50.0::DOUBLE, 'x1': 550.0::DOUBLE, 'y1': l_quantity::DOUBLE * 1.75::DOUBLE + 248}}
  ELSE {{'y0': l_discount::DOUBLE * 800 - 10, 'x0': l_quantity::DOUBLE * 3 + 120, 'x1': l_quantity::DOUBLE * 3 + 134, 'y1': l_discount::DOUBLE * 800 + 90}} END AS l FROM li WHERE i % 2 = 0),
p AS (SELECT doc_id, page, list(l ORDER BY l) AS l FROM r GROUP BY ALL),
u AS (SELECT g.doc_id, g.page, g.figure, min(b0 * (600.0::DOUBLE / 1000)) AS ux0, min(b1 * (800.0::DOUBLE / 1000)) AS uy0, max(b2 * (600.0::DOUBLE / 1000)) AS ux1, max(b3 * (800.0::DOUBLE / 1000)) AS uy1
  FROM g JOIN c ON c.doc_id = g.doc_id AND c.i BETWEEN g.first AND g.figure GROUP BY ALL),
b AS (SELECT doc_id, figure, ux0, uy0, ux1, uy1, ux0 - 5 AS x0, uy0 - 5 AS y0, ux1 + 5 AS x1, uy1 + 5 AS y1, coalesce(l, []) AS l FROM u LEFT JOIN p USING (doc_id, page)),
{", ".join(steps)}
SELECT doc_id, figure, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM {before}"""


def clashing_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placeholder prefix that a text already has is made longer than any that it has."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "X", "x").alias("text"))
    marked = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" __T_X "), F.repeat(F.lit("__T_XX_"), (F.col("doc_id") % 3).cast("int") - 1))).otherwise(""))
    prefix = protect.apart(marked, F.lit("__T_"))
    return docs.select("doc_id", prefix.alias("prefix"), marked.contains(prefix).alias("taken"))


CLASHING_PREFIXES = "SELECT doc_id, ['__T_', '__T_XX', '__T_XXX'][doc_id % 3 + 1] AS prefix, false AS taken FROM documents"

SYMBOLS = tuple((rf"\{k}", v) for k, v in pseudocode.COMMANDS.items())
GROUPS = tuple((rf"\{k}{{q}}", "q") for k in pseudocode.WRAPPERS) + tuple((rf"\{k}{{q}}", f"{k}(q)") for k in pseudocode.ACCENTS)


def listing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with every command that has a plain form, in turn."""
    all_ = F.array(*[F.lit(k) for k, _ in SYMBOLS + GROUPS])
    body = F.concat(F.lit("1: x "), F.get(all_, (F.col("p_partkey") % len(SYMBOLS + GROUPS)).cast("int")), F.lit(" y"))
    got = pseudocode.plain_listings(F.concat(F.lit('<div class="x-algorithm">'), body, F.lit("</div>")))
    return _table(spark, sf_dir, "part").select("p_partkey", got["text"].alias("text"))


LISTING_SYMBOLS = f"""SELECT p_partkey, '```text' || chr(10) || '1: x ' || [{", ".join(_quoted(v) for _, v in SYMBOLS + GROUPS)}][p_partkey % {len(SYMBOLS + GROUPS)} + 1] || ' y' || chr(10) || '```' AS text FROM part"""

KEYED = translate.Settings(model="ds-v4-pro", terms=("alpha", "beta"), glossary='a "b"')


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of texts: a text's own, and another for each setting that shapes the answer."""
    text = F.coalesce("text", F.lit(""))
    others = [translate.Settings(), translate.Settings(model="deepseek-v4-pro", terms=("alpha", "beta"), glossary='a "b"', tries=5)]
    keys = [translate.cache_key(text, s) for s in (KEYED, *others)]
    return _table(spark, sf_dir, "documents").select("doc_id", keys[0].alias("key"), (keys[0] == keys[1]).alias("same_by_default"), (keys[0] == keys[2]).alias("same_by_alias"))


def _cache_keys() -> str:
    fixed = {
        "base_url": "http://localhost",
        "glossary": KEYED.glossary,
        "model": "deepseek-v4-pro",
        "prompt": translate.system_prompt(KEYED),
        "source_language": "en",
        "target_language": "zh-CN",
        "terms": "alpha\nbeta",
        "version": "1",
    }
    head = json.dumps(fixed, ensure_ascii=False, separators=(",", ":"))[:-1] + ',"text":'
    return f"SELECT doc_id, sha256({_quoted(head)} || to_json(coalesce(text, ''))::VARCHAR || '}}') AS key, false AS same_by_default, true AS same_by_alias FROM documents"


QUERIES: dict[Callable[[SparkSession, str], DataFrame], str] = {
    split_ranks: SPLIT_RANKS,
    span_kinds: SPAN_KINDS,
    crop_lines: _crop_lines(),
    clashing_prefixes: CLASHING_PREFIXES,
    listing_symbols: LISTING_SYMBOLS,
    cache_keys: _cache_keys(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in QUERIES.items()}
