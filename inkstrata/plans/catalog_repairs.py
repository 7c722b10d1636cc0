"""Registered queries of predicates, repairs, captions, caches and jobs, each beside its SQL.

As in ``catalog``, texts are rendered from relational tables inside a query, and the SQL says from
the base tables alone what has to come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import cleanup, markdown, protect, pseudocode, validate
from inkstrata.functions.text import redact
from inkstrata.operators import assets, figures, jobs, segment, tables
from inkstrata.plans import translate
from inkstrata.sources import readers

from .catalog import _content, _dealt, _items, _joined, _plans, _table
from .catalog_sql import CONTENT, LI

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"


def outer_fence(spark, sf_dir):
    text = F.concat(F.lit("T "), F.coalesce("text", F.lit("")))
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, F.concat(F.lit("```markdown\n"), text, F.lit("\n```"))).when(k == 1, F.concat(F.lit(" \n```MD \n"), text, F.lit("\n```\n"))).otherwise(F.concat(F.lit("```python\n"), text, F.lit("\n```")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(cleanup.without_outer_fence(answer), 256).alias("answer_sha256"))


OUTER_FENCE = "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 2 THEN '```python' || chr(10) || 'T ' || coalesce(text, '') || chr(10) || '```' ELSE 'T ' || coalesce(text, '') END) AS answer_sha256 FROM documents"


def outer_space(spark, sf_dir):
    n = F.col("doc_id").cast("int")
    source = F.concat(F.repeat(F.lit("\n"), n % 3), F.lit("S"), F.repeat(F.lit("\t"), n % 4))
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(cleanup.with_outer_space(source, F.concat(F.lit(" \n"), F.coalesce("text", F.lit("")))), 256).alias("text_sha256"))


OUTER_SPACE = f"SELECT doc_id, sha256(repeat(chr(10), (doc_id % 3)::INT) || trim(coalesce(text, ''), {SPACES}) || repeat(chr(9), (doc_id % 4)::INT)) AS text_sha256 FROM documents"


def code_terms(spark, sf_dir):
    words = F.regexp_replace(F.coalesce("html", F.lit("")), "[^A-Za-z ]+", " ")
    source = F.when(F.col("page_id") % 2 == 0, "see `der` and the").otherwise("see der and the")
    fixed = cleanup.without_code_terms(source, F.regexp_replace(words, "(der|the)", "`$1`"), ("der", "the"))
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(fixed, 256).alias("text_sha256"))


CODE_TERMS = "WITH w AS (SELECT page_id, regexp_replace(coalesce(html, ''), '[^A-Za-z ]+', ' ', 'g') AS w FROM pages) SELECT page_id, sha256(CASE WHEN page_id % 2 = 0 THEN replace(w, 'der', '`der`') ELSE w END) AS text_sha256 FROM w"


def strong_spaces(spark, sf_dir):
    flag, key = F.col("l_returnflag"), F.col("l_partkey").cast("string")
    before, after = F.when(flag == "N", "").otherwise(" "), F.when(flag == "A", "").otherwise("\n")
    docs = _joined(_items(spark, sf_dir), F.concat(F.lit("x"), before, F.lit("**"), key, F.lit("**"), after, F.lit("y")))
    bare = _joined(_items(spark, sf_dir), F.concat(F.lit("X**"), key, F.lit("**Y"))).withColumnRenamed("text", "bare")
    target = F.when(F.col("doc_id") % 5 == 0, F.concat("bare", F.lit("**"))).otherwise(F.col("bare"))
    return docs.join(bare, "doc_id").select("doc_id", F.sha2(cleanup.with_strong_space(F.col("text"), target), 256).alias("text_sha256"))


STRONG_SPACES = f"""WITH {LI} SELECT l_orderkey AS doc_id, sha256(CASE WHEN l_orderkey % 5 = 0 THEN string_agg('X**' || l_partkey || '**Y', '' ORDER BY i) || '**'
  ELSE string_agg('X' || CASE WHEN l_returnflag = 'N' THEN '' ELSE ' ' END || '**' || l_partkey || '**' || CASE WHEN l_returnflag = 'A' THEN '' ELSE chr(10) END || 'Y', '' ORDER BY i) END) AS text_sha256 FROM li GROUP BY l_orderkey"""


def reference_titles(spark, sf_dir):
    flag = F.col("l_returnflag")
    head = F.when((flag == "R") & (F.col("l_partkey") % 2 == 0), "## References ##\n\n").when(flag == "R", "## Bibliography.\n\n").when(flag == "A", "## 7 References\n\n").otherwise("# Note\n\n")
    parts = segment.document_parts(_joined(_items(spark, sf_dir), head), target_language="zh-CN")
    zh = F.col("text") == "## 参考文献\n\n"
    return parts.groupBy("doc_id").agg(F.count_if(zh).alias("n_references"), F.count_if(F.col("text") == "## 7 References\n\n").alias("n_others"), F.count_if(F.col("text") == "# Note\n\n").alias("n_notes"), F.count_if(~F.col("translatable")).alias("n_fixed"))


REFERENCE_TITLES = "SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R') AS n_references, count(*) FILTER (l_returnflag = 'A') AS n_others, count(*) FILTER (l_returnflag = 'N') AS n_notes, count(*) FILTER (l_returnflag = 'R') AS n_fixed FROM lineitem GROUP BY 1"


def untranslated_parts(spark, sf_dir):
    line = F.when(F.col("l_returnflag") == "R", "~~~\nwords\n\nwords\n~~~\n\n").when(F.col("l_returnflag") == "A", '![](images/a.jpg) <img src="b.png"> --- "*"\n\n').otherwise(F.concat(F.lit("Part "), F.col("l_partkey"), F.lit("\n\n")))
    docs = _joined(_items(spark, sf_dir), line)
    parts = segment.document_parts(docs.withColumn("text", F.concat(F.lit("---\ntitle: words\n---\n\n"), F.col("text"), F.lit("---\nlast: words\n---"))))
    return parts.groupBy("doc_id").agg(F.count_if("translatable").alias("n_free"), F.count_if(~F.col("translatable")).alias("n_fixed"), F.count_if(F.col("translatable") & F.col("text").startswith("---")).alias("n_free_rules"))


UNTRANSLATED_PARTS = "SELECT l_orderkey AS doc_id, 1 + count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS n_free, 1 + count(*) FILTER (l_returnflag IN ('R', 'A')) AS n_fixed, 1::BIGINT AS n_free_rules FROM lineitem GROUP BY 1"


def table_lines(spark, sf_dir):
    n = F.col("l_quantity").cast("int") % 6
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" |:"), F.repeat(F.lit("-"), n), F.lit(":| --- |"))).when(F.col("l_returnflag") == "A", F.concat(F.repeat(F.lit("-"), n), F.lit("|:---"))).otherwise(F.concat(F.lit("a "), F.repeat(F.lit("|"), n), F.lit(" b")))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line"))
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(markdown.is_table_row(F.col("line"))).alias("n_rows"), F.count_if(markdown.is_separator(F.col("line"))).alias("n_separators"))


TABLE_LINES = "SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag IN ('R', 'A') OR l_quantity::INT % 6 > 0) AS n_rows, count(*) FILTER (l_returnflag IN ('R', 'A') AND l_quantity::INT % 6 >= 3) AS n_separators FROM lineitem GROUP BY 1"


def placeholder_rules(spark, sf_dir):
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("$x_"), F.col("l_partkey"), F.lit("$ "))).when(F.col("l_returnflag") == "A", F.concat(F.lit("`c"), F.col("l_partkey"), F.lit("` "))).otherwise(F.concat(F.lit("<b"), F.col("l_partkey"), F.lit("> ")))
    docs = _joined(_items(spark, sf_dir), line)
    kept = docs.select("doc_id", F.explode(F.array(protect.protect(F.col("text")))).alias("p"))
    marks = F.transform(F.col("p")["replacements"], lambda r: r["placeholder"])
    turned, short = F.array_join(F.reverse(marks), " "), F.array_join(F.slice(marks, F.lit(2), F.size(marks)), " ")
    return kept.select(
        "doc_id",
        F.size(F.filter(F.col("p")["replacements"], lambda r: r["ordered"])).cast("long").alias("n_ordered"),
        F.sha2(F.coalesce(protect.restore(turned, F.col("p"))["text"], F.lit("")), 256).alias("turned_sha256"),
        F.coalesce(protect.restore(turned, F.col("p"))["error"], F.lit("")).alias("turned_error"),
        F.coalesce(protect.restore(short, F.col("p"))["error"], F.lit("")).alias("short_error"),
    )


PLACEHOLDER_RULES = f"""WITH {LI}, v AS (SELECT *, CASE l_returnflag WHEN 'R' THEN '$x_' || l_partkey || '$' WHEN 'A' THEN '`c' || l_partkey || '`' ELSE '<b' || l_partkey || '>' END AS v FROM li)
SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'N') AS n_ordered, sha256(CASE WHEN count(*) FILTER (l_returnflag = 'N') < 2 THEN string_agg(v, ' ' ORDER BY i DESC) ELSE '' END) AS turned_sha256,
  CASE WHEN count(*) FILTER (l_returnflag = 'N') < 2 THEN '' ELSE 'ordered placeholders moved' END AS turned_error, 'placeholders changed, lost or repeated' AS short_error FROM v GROUP BY 1"""


def listing_lines(spark, sf_dir):
    symbol = F.element_at(F.array(*[F.lit(x) for x in (r"\Leftrightarrow", r"\in", r"\infty", r"\leq", r"\le", r"\Longrightarrow", r"\words")]), (F.col("p_size") % 7 + 1).cast("int"))
    blank = F.when(F.col("p_size") % 2 == 0, "<br><br><br>").otherwise("<br><br>")
    body = F.concat(F.lit("Algorithm "), F.col("p_partkey"), F.lit(r"</p>1: <em>\textbf{if}</em> $x_{12} "), symbol, F.lit(r" y^{n+1}$ then"), blank, F.lit(r"2: x<sup>2</sup> \leftarrow \hat{\mathbf{y}} \quad f (a , \frac{b}{c})<br>3: end if"))
    text = F.concat(F.lit('<div class="plain">k</div>\n<div class="big x-algorithm">'), body, F.lit("</div>"))
    got = pseudocode.plain_listings(text)
    return _dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", got["text"].alias("text"), got["blocks"].cast("long").alias("blocks"))


LISTING_LINES = r"""SELECT p_partkey, '<div class="plain">k</div>' || chr(10) || '**Algorithm ' || p_partkey || '**' || chr(10, 10) || '```text' || chr(10) || '1: if x_12 ' || ['⇔', '∈', '∞', '≤', '≤', '⇒', 'words'][p_size % 7 + 1] || ' y^(n+1) then' || chr(10)
  || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) END || '2:     x^(2) ← hat(y) f(a, (b) / (c))' || chr(10) || '3: end if' || chr(10) || '```' AS text, 1::BIGINT AS blocks FROM part""".replace("chr(10, 10)", "chr(10) || chr(10)")


def shared_paths(spark, sf_dir):
    key = F.col("l_partkey").cast("string")
    line = F.concat(F.lit("![a](images/p%20"), key, F.lit('.jpg "t") ![b](<images/p '), key, F.lit(".jpg?v=1>) <img src='./images/ü"), key, F.lit(".jpg#f'>\n"))
    docs = _joined(_items(spark, sf_dir), line)
    some = _table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("doc_id"), "l_partkey")
    files = some.select("doc_id", F.explode(F.array(F.concat(F.lit("images/p "), "l_partkey", F.lit(".jpg")), F.concat(F.lit("images/ü"), "l_partkey", F.lit(".jpg")))).alias("path"))
    out = assets.shared_files(docs, files)
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("shared_assets").cast("long").alias("shared_assets"))


SHARED_PATHS = f"""WITH {LI} SELECT l_orderkey AS doc_id, sha256(string_agg(CASE WHEN l_partkey % 3 <> 0
  THEN '![a](../images/p%20' || l_partkey || '.jpg "t") ![b](<../images/p%20' || l_partkey || '.jpg?v=1>) <img src=''../images/%C3%BC' || l_partkey || '.jpg#f''>'
  ELSE '![a](images/p%20' || l_partkey || '.jpg "t") ![b](<images/p ' || l_partkey || '.jpg?v=1>) <img src=''./images/ü' || l_partkey || '.jpg#f''>' END || chr(10), '' ORDER BY i)) AS text_sha256,
  2 * count(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0) AS shared_assets FROM li GROUP BY 1"""


def asset_copies(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("images/"), "l_partkey", F.lit(".jpg")).alias("path"), "l_partkey").distinct()
    references = rows.select("doc_id", F.col("path").alias("raw"), "path")
    files = rows.where("l_partkey % 3 <> 0").select("doc_id", "path", F.lit("new").alias("sha256"))
    present = rows.where("l_partkey % 5 < 2").select("doc_id", "path", F.when(F.col("l_partkey") % 5 == 0, "new").otherwise("old").alias("sha256"))
    return assets.copy_plan(references, files, present)


ASSET_COPIES = "SELECT DISTINCT l_orderkey AS doc_id, 'images/' || l_partkey || '.jpg' AS path FROM lineitem WHERE l_partkey % 3 <> 0 AND l_partkey % 5 <> 0"


def keep_conflicts(spark, sf_dir):
    path = F.concat(F.when(F.col("l_linestatus") == "F", "deep/").otherwise(""), F.lit("r"), F.col("i"), F.lit("/images/"), F.col("l_suppkey") % 3, F.lit(".jpg"))
    return assets.slim_plan(_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), path.alias("path"), F.col("l_returnflag").alias("sha256")))


KEEP_CONFLICTS = f"""WITH {LI}, f AS (SELECT l_orderkey AS doc_id, l_returnflag AS h, 'images/' || l_suppkey % 3 || '.jpg' AS dest, l_linestatus = 'F' AS deep, CASE WHEN l_linestatus = 'F' THEN 'deep/' ELSE '' END || 'r' || i || '/images/' || l_suppkey % 3 || '.jpg' AS path FROM li)
SELECT doc_id, path, dest, CASE WHEN min(h) OVER w <> max(h) OVER w THEN 'conflict' WHEN row_number() OVER (PARTITION BY doc_id, dest ORDER BY deep, path) = 1 THEN 'keep' ELSE 'same' END AS action FROM f WINDOW w AS (PARTITION BY doc_id, dest)"""


def merged_spans(spark, sf_dir):
    flag = F.col("l_returnflag")
    pipe = F.concat(F.lit("| a | b |\n|---|---|\n| "), F.col("l_partkey"), F.lit(" | 1 |\n"))
    line = F.when(flag == "R", F.concat(F.lit("<table>\n"), pipe, F.lit("</table>\n\n"))).when(flag == "A", F.concat(F.lit("<table><tr><td>"), F.col("l_partkey"), F.lit("</td></tr></table>\n"), pipe, F.lit("\n"))).otherwise(F.concat(F.lit("words | words\n\n"), pipe, F.lit("\n")))
    found = tables.document_tables(_joined(_items(spark, sf_dir), line))
    html = F.col("body").startswith("<table>")
    return found.groupBy("doc_id").agg(F.count_if(html).alias("n_html"), F.count_if(~html).alias("n_pipe"), F.count_if(html & F.col("body").contains("|---|")).alias("n_both"))


MERGED_SPANS = "SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag IN ('R', 'A')) AS n_html, count(*) FILTER (l_returnflag <> 'R') AS n_pipe, count(*) FILTER (l_returnflag = 'R') AS n_both FROM lineitem GROUP BY 1"


def caption_tables(spark, sf_dir):
    key = F.col("l_partkey").cast("string")
    cell = F.concat(F.lit("<table><caption>Part "), key, F.lit("</caption><tr><td>"), F.col("l_suppkey") % 2, F.lit("</td></tr><CAPTION a='b'>two</CAPTION></table>"))
    rows = _items(spark, sf_dir, "l_suppkey")
    content = rows.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(F.lit("b"), F.when(F.col("l_orderkey") % 2 == 0, "a"))).alias("list"), "i", F.lit("table").alias("type"), cell.alias("table_body"), F.concat(F.lit("images/t "), F.col("i"), F.lit(".jpg")).alias("img_path")).where("list is not null")
    # Of even orders list a comes first; but where it lacks a table, list b is taken.
    content = content.where("not (list = 'a' and doc_id % 4 = 0 and i = 0)")
    out = tables.tables_to_images(_joined(rows, F.concat(cell, F.lit("\n"))), tables.table_images(content, content.select("doc_id", F.col("img_path").alias("path"))))
    return out.select("doc_id", "content_list", "table_mode", F.sha2("text", 256).alias("text_sha256"))


CAPTION_TABLES = f"""WITH {LI} SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 4 = 2 THEN 'a' ELSE 'b' END AS content_list, 'image' AS table_mode,
  sha256(string_agg('Part ' || l_partkey || chr(10) || chr(10) || 'two' || chr(10) || chr(10) || '![](images/t%20' || i || '.jpg)' || chr(10) || chr(10), '' ORDER BY i)) AS text_sha256 FROM li GROUP BY 1"""


def layout_items(spark, sf_dir):
    flag, k = F.col("l_returnflag"), F.col("i").cast("string")
    none = F.lit(None).cast("string")
    listed = F.to_json(F.array(F.lit(" "), F.concat(F.lit("Figure "), k, F.lit(". x")), F.lit("(a) y")))
    item = F.struct(
        F.when(flag == "R", "image").when(flag == "A", "chart").otherwise("table").alias("type"), (F.col("i") % 7).cast("string").alias("page_idx"), F.array("l_quantity", "l_discount", "l_quantity", "l_tax").alias("bbox"),
        F.concat(F.lit("images/"), k, F.lit(".jpg")).alias("img_path"), F.when(flag == "R", listed).otherwise(none).alias("image_caption"), F.when(flag == "A", F.concat(F.lit("Fig "), k, F.lit(": z"))).alias("chart_caption"), F.when(flag == "N", " ").alias("table_caption"),
    )
    lists = _items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("i", item.alias("x")))), lambda x: x["x"])).alias("json"))
    found = readers.content_items(lists.withColumn("list", F.lit("l")))
    return found.select("doc_id", F.col("i").cast("long").alias("i"), "type", F.col("page_idx").cast("long").alias("page_idx"), F.array_join(F.transform("captions", lambda c: c), "/").alias("captions"), F.coalesce(figures.figure_number(F.col("captions")), F.lit(-1)).cast("long").alias("figure"), F.col("bbox")[0].alias("x0"))


LAYOUT_ITEMS = f"""WITH {LI} SELECT l_orderkey AS doc_id, i, CASE l_returnflag WHEN 'R' THEN 'image' WHEN 'A' THEN 'chart' ELSE 'table' END AS type, i % 7 AS page_idx,
  CASE l_returnflag WHEN 'R' THEN 'Figure ' || i || '. x/(a) y' WHEN 'A' THEN 'Fig ' || i || ': z' ELSE '' END AS captions, CASE WHEN l_returnflag IN ('R', 'A') THEN i ELSE -1 END AS figure, l_quantity::DOUBLE AS x0 FROM li"""


def term_bullets(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    text = F.concat(F.lit("# terms\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("* `"), x, F.lit("`\r\n  - "), x, F.lit(" \nno term\n+ "), F.lower(x), F.lit("\n-\n"))), ""))
    return n.select(F.col("n_regionkey").cast("long").alias("region"), F.array_join(readers.term_list(text), ",").alias("terms"))


TERM_BULLETS = "SELECT n_regionkey::BIGINT AS region, string_agg(n_name || ',' || lower(n_name), ',' ORDER BY n_name) AS terms FROM nation GROUP BY 1"


def glossaries(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("x"))
    json = F.concat(F.lit("{"), F.array_join(F.transform("x", lambda x: F.concat(F.lit('"'), x["n_name"], F.lit('": "'), x["n_nationkey"], F.lit('"'))), ", "), F.lit("}"))
    text = F.when(F.col("n_regionkey") % 2 == 0, json).otherwise(F.concat(F.lit(" \n{not "), json, F.lit("\n")))
    g = readers.glossary(text)
    return n.select(F.col("n_regionkey").cast("long").alias("region"), g["lines"].alias("lines"), g["sha256"].alias("sha256"))


GLOSSARIES = """WITH g AS (SELECT n_regionkey::BIGINT AS region, CASE WHEN n_regionkey % 2 = 0 THEN string_agg('- ' || n_name || ' => ' || n_nationkey, chr(10) ORDER BY n_name)
  ELSE '{not {' || string_agg('"' || n_name || '": "' || n_nationkey || '"', ', ' ORDER BY n_name) || '}' END AS lines FROM nation GROUP BY n_regionkey) SELECT region, lines, sha256(lines) AS sha256 FROM g"""


def batch_results(spark, sf_dir):
    result = F.struct(F.concat(F.lit("f"), F.col("i")).alias("file_name"), F.col("l_partkey").alias("value"))
    rows = _items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", result.alias("r")))), lambda x: x["r"]).alias("results"))
    return rows.select("doc_id", jobs.batch_result(F.col("results"), F.concat(F.lit("f"), F.col("doc_id") % 9))["value"].cast("long").alias("value"))


BATCH_RESULTS = f"WITH {LI} SELECT l_orderkey AS doc_id, coalesce(max(CASE WHEN i = l_orderkey % 9 THEN l_partkey END), max(CASE WHEN i = 0 THEN l_partkey END))::BIGINT AS value FROM li GROUP BY 1"


def conversion_modes(spark, sf_dir):
    k = F.col("c_custkey")
    got = jobs.mode_of(F.element_at(F.array(F.lit("auto"), F.lit("agent"), F.lit("precise")), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, "t"), F.when(k % 5 == 0, "image").otherwise("html"), k % 7 != 0)
    return _table(spark, sf_dir, "customer").select("c_custkey", got["mode"].alias("mode"), got["error"].isNotNull().alias("refused"))


CONVERSION_MODES = """WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 2 OR (c_custkey % 3 = 0 AND c_custkey % 2 = 0) THEN 'precise' ELSE 'agent' END AS mode FROM customer)
SELECT k AS c_custkey, mode, (k % 5 = 0 AND (mode = 'agent' OR k % 7 = 0)) OR (mode = 'precise' AND k % 2 = 1) AS refused FROM m"""


def retry_waits(spark, sf_dir):
    rows = _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), jobs.backoff_seconds(F.col("i") + 1).alias("wait"))
    return rows.groupBy("doc_id").agg(F.sum("wait").alias("seconds"), F.max("wait").alias("longest"))


RETRY_WAITS = f"WITH {LI} SELECT l_orderkey AS doc_id, sum(CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END)::BIGINT AS seconds, max(CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END)::BIGINT AS longest FROM li GROUP BY 1"


def error_previews(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    secret = F.when(F.col("doc_id") % 4 > 0, F.get(F.split(text, "[ \n]"), F.lit(0))).otherwise("")
    return _table(spark, sf_dir, "documents").select("doc_id", redact(text, secret).alias("preview"))


ERROR_PREVIEWS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 4 > 0 THEN string_split_regex(coalesce(text, ''), '[ \\n]')[1] ELSE '' END AS s FROM documents)
SELECT doc_id, left(trim(regexp_replace(CASE WHEN s = '' THEN t ELSE replace(t, s, '<redacted>') END, '\\s+', ' ', 'g'), {SPACES}), 600) AS preview FROM d"""


def token_checks(spark, sf_dir):
    token = F.concat(F.repeat(F.lit("t"), F.col("c_custkey").cast("int") % 14), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(""), F.lit("k"))
    return _table(spark, sf_dir, "customer").select("c_custkey", readers.is_token(token).alias("fits"))


TOKEN_CHECKS = "SELECT c_custkey, c_custkey % 14 + 1 >= 12 AND c_custkey % 5 <> 0 AS fits FROM customer"


def url_prefixes(spark, sf_dir):
    def told(*pieces: str) -> Column:
        return F.concat(*[F.col("url") if x == "U" else F.lit(x) for x in pieces])

    source = told("see ", "U", " and ", "U", "/k end")
    target = told("siehe ", "U", "/k后 und ", "U", "abc, ", "U", "/other ", "U", "/kZ ", "U", "/k")
    return _table(spark, sf_dir, "pages").select("page_id", cleanup.with_url_ends(source, target).alias("fixed"))


URL_PREFIXES = "SELECT page_id, 'siehe ' || url || '/k 后 und ' || url || ' abc, ' || url || '/other ' || url || '/k Z ' || url || '/k' AS fixed FROM pages"


def sound_translations(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    table, url = F.concat(F.lit("<table><tr><td>"), key, F.lit("</td></tr></table>")), F.concat(F.lit("https://e.org/"), key)
    source = F.concat(F.lit("# Head\n\n"), table, F.lit(" **b** $x$ "), url, F.lit(" end\n"))
    changed = (
        source, F.replace(source, F.lit("# Head"), F.lit("## Head")), F.replace(source, F.lit("<td>"), F.lit("")), F.concat(source, F.lit("__MDT_")), F.concat(source, F.lit("**")),
        F.concat(F.lit("# Kopf\n\n"), table, F.lit(" "), url, F.lit(" $x$ **b** ende\n")), F.concat(F.lit("# Head\n\n"), url, F.lit(" "), table, F.lit(" **b** $x$ end\n")), F.replace(source, F.lit("e.org"), F.lit("e.net")),
        F.replace(source, F.lit("# Head"), F.lit("Head")),
    )
    target = F.element_at(F.array(*changed), (F.col("c_custkey") % len(changed) + 1).cast("int"))
    return _dealt(_table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.array_join(validate.failures(source, target), "; ").alias("failures"), validate.structure_matches(source, target).alias("same_structure"))


SOUND_TRANSLATIONS = """SELECT c_custkey, ['', 'headings', 'table marks; protected values; protected order', 'placeholder left', 'strong marks unpaired', '', 'protected order', 'protected values; protected order', 'headings'][c_custkey % 9 + 1] AS failures,
  c_custkey % 9 NOT IN (1, 2, 8) AS same_structure FROM customer"""


def side_clamps(spark, sf_dir):
    d = lambda x: F.lit(float(x))
    q = F.col("l_quantity")
    union = F.struct(d(100).alias("x0"), d(100).alias("y0"), d(300).alias("x1"), d(300).alias("y1"))
    lines = F.array(*[F.struct(x0.alias("x0"), d(120).alias("y0"), (x0 + 10).alias("x1"), d(280).alias("y1")) for x0 in (q + 50, q + 270)])
    box = figures.clamped(figures.padded(union, 5.0), union, lines)
    return _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("i").cast("long").alias("i"), *[box[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


SIDE_CLAMPS = f"""WITH {LI} SELECT l_orderkey AS doc_id, i, CASE WHEN l_quantity + 50 < 95 AND l_quantity + 60 > 95 THEN least(100.0::DOUBLE, l_quantity + 60.5) ELSE 95.0::DOUBLE END AS x0, 95.0::DOUBLE AS y0,
  CASE WHEN l_quantity + 270 < 305 AND l_quantity + 280 > 305 THEN greatest(300.0::DOUBLE, l_quantity + 269.5) ELSE 305.0::DOUBLE END AS x1, 305.0::DOUBLE AS y1 FROM li"""


def cache_lookup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id")).withColumn("key", F.sha2("text", 256))
    broken, stale = F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0
    cache = docs.where("doc_id % 2 = 0").select("key", F.when(broken, F.concat("text", F.lit(" <td>"))).otherwise(F.concat(F.lit(" "), "text")).alias("translation"), F.when(stale, -1).otherwise(translate.VERSION).alias("version"))
    hits = translate.cache_hits(docs.select("key", "text"), cache, ())
    return docs.join(hits, "key").select("doc_id", F.sha2("translation", 256).alias("text_sha256"))


CACHE_LOOKUP = """SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents GROUP BY coalesce(text, '')
HAVING min(doc_id) % 2 = 0 AND min(doc_id) % 5 <> 0 AND min(doc_id) % 7 <> 0 AND len(regexp_extract_all(coalesce(text, ''), '\\*\\*')) % 2 = 0"""


def usage_sums(spark, sf_dir):
    return translate.usage(_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), (F.col("l_partkey") + F.col("l_suppkey")).alias("total_tokens")))


USAGE_SUMS = "SELECT sum(l_partkey)::BIGINT AS prompt_tokens, sum(l_suppkey)::BIGINT AS completion_tokens, sum(l_partkey + l_suppkey)::BIGINT AS total_tokens FROM lineitem"


def figure_rewrites(spark, sf_dir):
    rows = _items(spark, sf_dir)
    label = F.when(F.col("l_partkey") % 3 == 0, "\n(a) part").otherwise("")
    words = F.when(F.col("l_quantity") > 42, "\nwords").otherwise("")
    docs = _joined(rows, F.concat(F.lit("![](images/a"), F.col("i"), F.lit(".jpg)"), label, words, F.lit("\n\n")))
    groups = figures.figure_groups(_content(spark, sf_dir)).join(docs, "doc_id")
    out = figures.rewrite(F.col("text"), F.transform("panels", lambda p: p["img"]), F.format_string("figure-%02d.jpg", F.col("figure")))
    return groups.select("doc_id", F.col("figure").cast("long").alias("figure"), out["status"].alias("status"), F.sha2(F.coalesce(out["text"], F.lit("")), 256).alias("text_sha256"))


FIGURE_REWRITES = f"""WITH {CONTENT}, f AS (SELECT g.doc_id, figure, first, i, l_quantity > 42 AS bad, CASE WHEN l_partkey % 3 = 0 THEN '(a) part' || chr(10) ELSE '' END AS label,
  CASE WHEN l_partkey % 3 = 0 THEN chr(10) || '(a) part' ELSE '' END || CASE WHEN l_quantity > 42 THEN chr(10) || 'words' ELSE '' END || chr(10) || chr(10) AS tail FROM g JOIN li ON l_orderkey = doc_id),
s AS (SELECT doc_id, figure, first, coalesce(bool_or(bad) FILTER (i BETWEEN first AND figure - 1), false) AS bad,
  coalesce(string_agg('![](images/a' || i || '.jpg)' || tail, '' ORDER BY i) FILTER (i < first), '') || '![](images/' || printf('figure-%02d.jpg', figure) || ')' || chr(10) || coalesce(string_agg(label, '' ORDER BY i) FILTER (i BETWEEN first AND figure - 1), '')
  || max(tail) FILTER (i = figure) || coalesce(string_agg('![](images/a' || i || '.jpg)' || tail, '' ORDER BY i) FILTER (i > figure), '') AS text FROM f GROUP BY doc_id, figure, first)
SELECT doc_id, figure, CASE WHEN bad THEN 'skip: unexpected content between panels (words)' ELSE 'merged ' || (figure - first + 1) || ' panels -> images/' || printf('figure-%02d.jpg', figure) END AS status, sha256(CASE WHEN bad THEN '' ELSE text END) AS text_sha256 FROM s"""


def figure_checks(spark, sf_dir):
    plans, content = _plans(spark, sf_dir)
    overlaps = figures.text_overlaps(plans, content)
    panels = F.array_join(F.transform("panels", lambda p: F.concat(F.lit("![](images/"), p["img"], F.lit(")\n"))), "")
    folded = F.concat(F.lit("![](images/"), F.col("file"), F.lit(")\n"))
    k = F.col("doc_id") % 8
    # Folded once, folded twice, apart with words between, apart, or not there at all.
    line = F.when(k % 4 == 0, folded).when(k % 4 == 1, F.repeat(folded, 2)).when(k == 2, F.replace(panels, F.lit(")"), F.lit(")\nwords"))).when(k == 6, panels).otherwise("")
    docs = plans.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("text"))
    crops = plans.where("figure % 5 <> 4").select("doc_id", "file", (F.col("width_px") + F.col("figure") % 3 * 2).alias("width_px"), "height_px")
    got = figures.verify(plans, docs, crops, overlaps)
    return got.select("doc_id", F.col("figure").cast("long").alias("figure"), "status", F.array_join("failures", "; ").alias("failures"))


FIGURE_CHECKS = f"""WITH {CONTENT}, o AS (SELECT DISTINCT box.doc_id, figure FROM box JOIN c ON c.doc_id = box.doc_id AND c.page = box.page AND c.type = 'text'
  WHERE greatest(0, least(x1, b2 * (600.0::DOUBLE / 1000)) - greatest(x0, b0 * (600.0::DOUBLE / 1000))) * greatest(0, least(y1, b3 * (800.0::DOUBLE / 1000)) - greatest(y0, b1 * (800.0::DOUBLE / 1000))) > 4),
s AS (SELECT g.doc_id, g.figure, o.figure IS NOT NULL AS hit, CASE WHEN g.doc_id % 4 = 3 THEN 'no reference' WHEN g.doc_id % 8 = 2 THEN 'left unfolded' WHEN g.figure % 5 = 4 THEN 'missing image' WHEN g.doc_id % 8 = 6 THEN 'mergeable' ELSE 'merged' END AS status FROM g LEFT JOIN o ON o.doc_id = g.doc_id AND o.figure = g.figure)
SELECT doc_id, figure, status, array_to_string(list_filter([CASE WHEN status = 'no reference' THEN 'neither the crop nor its panels are referred to' END, CASE WHEN status = 'missing image' THEN 'the crop does not exist' END,
  CASE WHEN status LIKE 'merge%' AND figure % 3 = 2 THEN 'the crop''s size is not that of its box' END, CASE WHEN status LIKE 'merge%' AND hit THEN 'the crop covers text' END,
  CASE WHEN status = 'mergeable' OR (status = 'merged' AND doc_id % 4 = 1) THEN 'references are wrong' END], lambda x: x IS NOT NULL), '; ') AS failures FROM s"""


def ink_bands(spark, sf_dir):
    edge = F.element_at(F.array(*[F.lit(e) for e in ("top", "left", "bottom", "right")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    dots = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.lit(1).alias("figure"), edge.alias("edge"), (F.col("l_partkey") % 7).alias("pos"), (F.floor("l_extendedprice") % 256).cast("int").alias("value"))
    got = figures.clean_offsets(figures.ink_counts(dots))
    return got.select("doc_id", "edge", F.coalesce("first_clean", F.lit(-1)).cast("long").alias("first_clean"), F.coalesce("last_clean", F.lit(-1)).cast("long").alias("last_clean"), "outer_inked")


INK_BANDS = """WITH d AS (SELECT l_orderkey % 500 AS doc_id, ['top', 'left', 'bottom', 'right'][l_suppkey % 4 + 1] AS edge, l_partkey % 7 AS pos, count(*) FILTER (floor(l_extendedprice)::BIGINT % 256 < 200) AS n FROM lineitem GROUP BY ALL)
SELECT doc_id, edge, coalesce(min(pos) FILTER (n < 3), -1)::BIGINT AS first_clean, coalesce(max(pos) FILTER (n < 3), -1)::BIGINT AS last_clean, CASE WHEN edge IN ('top', 'left') THEN arg_min(n, pos) ELSE arg_max(n, pos) END >= 3 AS outer_inked FROM d GROUP BY 1, 2"""


def sheet_offsets(spark, sf_dir):
    width = F.when(F.col("l_returnflag") == "R", 450).when(F.col("l_returnflag") == "A", 900).otherwise(1800)
    crops = _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.format_string("figure-%03d.jpg", F.col("i")).alias("file"), width.alias("width_px"), F.col("l_quantity").cast("int").alias("height_px"))
    return figures.sheet_layout(crops).select("doc_id", "file", "sheet_y", "sheet_height")


SHEET_OFFSETS = f"""WITH {LI}, s AS (SELECT l_orderkey AS doc_id, i, l_quantity::INT * CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0.5 END::DOUBLE AS h FROM li)
SELECT doc_id, printf('figure-%03d.jpg', i) AS file, 22.0::DOUBLE + 18 + coalesce(sum(h + 40) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sheet_y, h AS sheet_height FROM s"""


QUERIES: dict[Callable[[SparkSession, str], DataFrame], str] = {
    outer_fence: OUTER_FENCE, outer_space: OUTER_SPACE, code_terms: CODE_TERMS, strong_spaces: STRONG_SPACES, reference_titles: REFERENCE_TITLES, untranslated_parts: UNTRANSLATED_PARTS,
    table_lines: TABLE_LINES, placeholder_rules: PLACEHOLDER_RULES, listing_lines: LISTING_LINES, shared_paths: SHARED_PATHS, asset_copies: ASSET_COPIES, keep_conflicts: KEEP_CONFLICTS,
    merged_spans: MERGED_SPANS, caption_tables: CAPTION_TABLES, layout_items: LAYOUT_ITEMS, term_bullets: TERM_BULLETS, glossaries: GLOSSARIES, batch_results: BATCH_RESULTS,
    conversion_modes: CONVERSION_MODES, retry_waits: RETRY_WAITS, error_previews: ERROR_PREVIEWS, token_checks: TOKEN_CHECKS, cache_lookup: CACHE_LOOKUP, usage_sums: USAGE_SUMS,
    figure_rewrites: FIGURE_REWRITES, figure_checks: FIGURE_CHECKS, ink_bands: INK_BANDS, sheet_offsets: SHEET_OFFSETS,
    url_prefixes: URL_PREFIXES, sound_translations: SOUND_TRANSLATIONS, side_clamps: SIDE_CLAMPS,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in QUERIES.items()}
