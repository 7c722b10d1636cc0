"""Tables of a document matched to the images that a layout list has of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstrata.functions.markdown import captions_of_table, pieces_at, table_pieces, table_spans
from inkstrata.functions.text import let, paired, percent_decode, percent_encode, running

from .assets import beside, is_local, normalised

MODES = ("image", "auto", "html")


def table_images(content: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, lists (list, digests, paths): a document's lists by name, each with its table crops that exist in their order.

    ``content``: doc_id, list, i, type, table_body, img_path. ``files``: doc_id, path. Paths that leave
    the document's folder, aren't local, or aren't among its files are left out. Rows are gathered by
    document alone, with a digest for the body: what is grouped by document already isn't moved again.
    """
    rows = content.where((F.col("type") == "table") & F.col("table_body").isNotNull() & is_local(F.col("img_path")))
    rows = rows.withColumn("_raw", percent_decode(F.regexp_replace("img_path", r"[?#].*\z", ""))).withColumn("_path", normalised(F.col("_raw")))
    crop = F.struct("list", "i", _digest(F.col("table_body")).alias("digest"), F.col("_path").alias("path"), F.when(F.col("_raw") != F.col("_path"), F.col("_raw")).alias("raw"))
    crops = rows.select("doc_id", crop.alias("_c")).groupBy("doc_id").agg(F.collect_list("_c").alias("_crops"))
    own = files.groupBy("doc_id").agg(F.collect_set("path").alias("_own"))
    both = beside(crops, own, "doc_id", "inner").withColumn("_all", F.size(F.array_except(F.col("_crops")["path"], F.col("_own"))) == 0)
    # Mostly none is missing.
    there = both.select("doc_id", F.sort_array(F.when(F.col("_all"), F.col("_crops")).otherwise(_existing(F.col("_crops"), F.col("_own")))).alias("_crops"))
    one = F.size(F.array_distinct(F.col("_crops")["list"])) == 1
    return there.select("doc_id", F.when(one, F.array(_list(F.col("_crops")))).otherwise(_by_list(F.col("_crops"))).alias("lists"))


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _existing(crops: Column, own: Column) -> Column:
    """Those crops whose paths are among a document's own.

    A path that leaves its folder is null and no file's. Paths are put in order, each file's before the crops that may be it: a crop's is there if it is the last file's before it.
    """
    asked = F.transform(crops, lambda c: F.struct(c["path"].alias("path"), F.lit(1).alias("kind"), c.alias("crop")))
    files = F.transform(own, lambda p: F.struct(p.alias("path"), F.lit(0).alias("kind"), F.get(crops, F.lit(-1)).alias("crop")))

    def found(rows: Column) -> Column:
        last = running(F.transform(rows, lambda r: F.when(r["kind"] == 0, r["path"])), F.lit(None).cast("string"), lambda a, b: F.coalesce(b, a))
        return let(last, lambda last: F.filter(rows, lambda r, k: (r["kind"] == 1) & (r["path"] == F.get(last, k))))

    return let(F.sort_array(F.concat(files, asked)), found)["crop"]


def _list(crops: Column) -> Column:
    """(list, digests, paths) of the crops of one list in order."""
    return F.struct(F.get(crops, F.lit(0))["list"].alias("list"), crops["digest"].alias("digests"), F.transform(crops, lambda c: F.coalesce(c["raw"], c["path"])).alias("paths"))


def _by_list(crops: Column) -> Column:
    """Crops in order of their lists, cut into lists."""
    firsts = F.filter(F.transform(crops, lambda c, k: F.when((k == 0) | ~c["list"].eqNullSafe(F.get(crops, k - 1)["list"]), k)), lambda k: k.isNotNull())
    return let(firsts, lambda at: F.transform(at, lambda k, n: let(F.slice(crops, k + 1, F.coalesce(F.get(at, n + 1), F.size(crops)) - k), _list)))


def document_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t, body, k, start, stop, n: tables in order, the k-th (from 1) of the document with the same body.

    A table is at characters [start, stop) of the text (from 0), one of the document's n.
    """
    text = F.col(text_col)
    spans = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.explode(F.array(table_spans(text))).alias("_s"))
    found = F.transform("_s", lambda s: F.struct(F.substring(F.col("_text"), s["start"] + 1, s["stop"] - s["start"]).alias("body"), s["start"].alias("start"), s["stop"].alias("stop")))
    rows = spans.select("doc_id", F.size("_s").alias("n"), F.posexplode(found).alias("t", "_x"))
    return rows.select("doc_id", "t", "_x.body", F.row_number().over(W.partitionBy("doc_id", "_x.body").orderBy("t")).alias("k"), "_x.start", "_x.stop", "n")


def _match(digests: Column, lists: Column) -> Column:
    """(list, pictures) of the first of the lists that has an image for every table, else null.

    The k-th table with a body goes with the list's k-th image of that body.
    """

    def covered(own: Column) -> Column:
        some = let(paired(digests, own["digests"]), lambda at: F.when(F.forall(at, lambda k: k.isNotNull()), F.transform(at, lambda k: F.get(own["paths"], k))))
        pictures = F.when(F.size(own["digests"]) < F.size(digests), F.lit(None)).when(own["digests"] == digests, own["paths"]).otherwise(some)
        return F.struct(own["list"].alias("list"), pictures.alias("pictures"))

    return F.when(F.size(digests) > 0, F.get(F.filter(F.transform(lists, covered), lambda m: m["pictures"].isNotNull()), F.lit(0)))


def _put(pieces: Column, pictures: Column) -> Column:
    """The text of pieces (gaps and tables in turn) with the words of each table's captions, and its picture, in place of the table."""

    def piece(p: Column, i: Column) -> Column:
        words = F.array_join(F.transform(captions_of_table(p), lambda c: F.concat(c, F.lit("\n\n"))), "")
        return F.when(i % 2 == 0, p).otherwise(F.concat(words, F.lit("![]("), F.get(pictures, F.floor(i / 2).cast("int")), F.lit(")\n")))

    return F.array_join(F.transform(pieces, piece), "")


def _replaced(text: Column, spans: Column, pictures: Column) -> Column:
    """``_put`` where tables are given by their places."""
    return _put(pieces_at(text, spans), pictures)


def tables_to_images(docs: DataFrame, images: DataFrame, mode: str = "image", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text after replacement, table_mode, table_images, content_list and table_error.

    ``html`` leaves all tables. Where no list covers a document's tables, ``auto`` leaves its
    text and says ``html``; ``image`` gives an error and no text. Documents without tables stay.
    ``images`` are those of ``table_images``. Tables are found, matched and replaced where the text is, so a
    document's text and its crops are the largest thing held, and only the latter travel.
    """
    if mode not in MODES:
        raise ValueError(f"mode has to be one of {MODES}")
    text, none = F.col(text_col), F.lit(None).cast("string")
    if mode == "html":
        return docs.withColumns({"table_mode": F.lit("html"), "table_images": F.lit(0), "content_list": none, "table_error": none})
    rows = beside(docs, images.select("doc_id", F.col("lists").alias("_lists")), id_col).withColumn("_pieces", table_pieces(text))
    digests = F.transform(F.filter("_pieces", lambda p, i: i % 2 == 1), _digest)
    rows = rows.withColumn("_m", let(digests, lambda d: _match(d, F.col("_lists"))))
    n, hit = F.floor(F.size("_pieces") / 2).cast("int"), F.col("_m").isNotNull()
    missed = ~hit & F.coalesce(n > 0, F.lit(False))
    new = F.when(hit, let(F.transform(F.col("_m")["pictures"], percent_encode), lambda p: _put(F.col("_pieces"), p))).otherwise(text)
    rows = rows.withColumns(
        {
            text_col: F.when(missed & F.lit(mode == "image"), none).otherwise(new),
            "table_mode": F.when(hit, "image").when(missed, F.lit("html" if mode == "auto" else "image")).otherwise(F.lit(mode)),
            "table_images": F.when(hit, n).otherwise(0),
            "content_list": F.col("_m")["list"],
            "table_error": F.when(missed & F.lit(mode == "image"), F.lit("no content list has an image for every table")),
        }
    )
    return rows.drop("_lists", "_pieces", "_m")
