"""Figures of a page layout: groups of panels, crop geometry, overlaps, and their place in Markdown.

Input is a content table: doc_id, i (position in the document's list), type, page_idx,
bbox (four numbers on a grid of 1000), img_path, text, and the captions by type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstrata.functions.markdown import PANEL_LABEL
from inkstrata.functions.text import found, is_blank, let, places, strip

# Layout types, caption and reference patterns, and the geometry's constants.
CAPTION = r"(?U)\A\s*(?:Figure|Fig\.?|图)\s*(\d+)\s*[.．:：。]"
PANEL_TYPES = ("chart", "image")
CAPTION_TYPES = ("chart", "image", "table")
TEXT_TYPES = ("text", "header", "footer", "page_number", "page_footnote", "aside_text")
PANEL_REFERENCE = r"!\[\]\((?:\.\./)?images/([0-9a-f]+\.jpg)\)"
REFERENCE = r"!\[\]\((?:\.\./)?images/[^)\n]+\)"
ANY_REFERENCE = r"!\[\]\((?:[^)]*/)?images/([^)]+)\)"
GRID = 1000.0
EDGE_MARGIN = 0.5
PASSES = 4
CLEAN_PIXELS = 3
DARK = 200
DPI, INK_DPI = 300, 150
GONE = "skip: already merged or refs not found"


def captions(caption: Column) -> Column:
    """Captions that aren't blank: a JSON list, or one plain string."""
    listed = F.from_json(caption, "array<string>")
    return F.filter(F.coalesce(F.when(F.ltrim(caption).startswith("["), listed), F.array(caption)), lambda c: c.isNotNull() & ~is_blank(c))


def figure_number(caps: Column) -> Column:
    """Number in the first caption that opens with a figure's name, null if none does."""
    return F.get(F.filter(F.transform(caps, lambda c: F.regexp_extract(c, CAPTION, 1)), lambda x: x != ""), 0).cast("int")


def figure_groups(content: DataFrame, *keep: str) -> DataFrame:
    """doc_id, page_idx, figure, panels (i, img, bbox) of every figure of two or more panels.

    A captioned chart, image or table closes a run of charts and images before it on the
    same page that have no caption but panel labels. Neighbours are rows whose numbers follow one another.
    Rows move by document and page, so a document of any size is dealt out; the window and
    the aggregate share that one exchange. Items without a page, document or number are in no group.
    """
    caps = F.when(F.col("type").isin(*CAPTION_TYPES), F.col("captions")).otherwise(F.array().cast("array<string>"))
    rows = content.where("doc_id is not null and i is not null and page_idx is not null").withColumn("_caps", F.coalesce(caps, F.array().cast("array<string>")))
    absorbs = F.col("type").isin(*PANEL_TYPES) & (F.size(F.filter("_caps", lambda c: ~c.rlike(PANEL_LABEL))) == 0)
    rows = rows.select("doc_id", "page_idx", "i", "img_path", "bbox", *keep, F.coalesce(absorbs, F.lit(False)).alias("_absorbs"), figure_number(F.col("_caps")).alias("_figure"))
    page = W.partitionBy("doc_id", "page_idx").orderBy("i")
    opens = (F.lag("i").over(page).isNull() | (F.col("i") - F.lag("i").over(page) != 1) | ~F.lag("_absorbs").over(page)).cast("int")
    runs = rows.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(page))
    grouped = runs.groupBy("doc_id", "page_idx", "_run").agg(F.max_by("_figure", "i").alias("figure"), F.sort_array(F.collect_list(F.struct("i", F.element_at(F.split("img_path", "/"), -1).alias("img"), "bbox", *keep))).alias("panels"))
    return grouped.where("figure is not null and size(panels) > 1").select("doc_id", "page_idx", "figure", "panels")


def union_box(panels: Column, width: Column, height: Column) -> Column:
    """(x0, y0, x1, y1) around the panels, in points of the page."""

    def edge(k: int, size: Column, pick) -> Column:
        return pick(F.transform(panels, lambda p: p["bbox"][k] * (size / GRID)))

    return F.struct(edge(0, width, F.array_min).alias("x0"), edge(1, height, F.array_min).alias("y0"), edge(2, width, F.array_max).alias("x1"), edge(3, height, F.array_max).alias("y1"))


def padded(box: Column, pad: float) -> Column:
    return F.struct((box["x0"] - pad).alias("x0"), (box["y0"] - pad).alias("y0"), (box["x1"] + pad).alias("x1"), (box["y1"] + pad).alias("y1"))


def clamped(box: Column, union: Column, text_lines: Column, margin: float = EDGE_MARGIN, passes: int = PASSES) -> Column:
    """The box with edges drawn in off text lines they would cut, never past the union.

    A fold over the page's lines (x0, y0, x1, y1): upper and lower edges first, then the
    sides, as often as ``passes`` says; a pass that moves nothing changes nothing after it.
    """

    def with_(b: Column, **new: Column) -> Column:
        return F.struct(*[(new[k] if k in new else b[k]).alias(k) for k in ("x0", "y0", "x1", "y1")])

    def drawn(b: Column, r: Column, low: str, high: str, across: tuple[str, str]) -> Column:
        beside = (r[across[1]] <= b[across[0]]) | (r[across[0]] >= b[across[1]])
        down = F.greatest(union[high], F.least(b[high], r[low] - margin))
        up = F.least(union[low], F.greatest(b[low], r[high] + margin))
        cuts_high = (r[low] < b[high]) & (b[high] < r[high]) & (down < b[high] - 1e-9)
        cuts_low = (r[low] < b[low]) & (b[low] < r[high]) & (up > b[low] + 1e-9)
        first, then = ((cuts_high, {high: down}), (cuts_low, {low: up})) if low == "y0" else ((cuts_low, {low: up}), (cuts_high, {high: down}))
        return F.when(beside, b).when(first[0], with_(b, **first[1])).when(then[0], with_(b, **then[1])).otherwise(b)

    for _ in range(passes):
        box = F.aggregate(text_lines, box, lambda b, r: drawn(b, r, "y0", "y1", ("x0", "x1")))
        box = F.aggregate(text_lines, box, lambda b, r: drawn(b, r, "x0", "x1", ("y0", "y1")))
    return box


def pixels(length: Column, dpi: int = DPI) -> Column:
    """Points at a resolution as whole pixels, halves to even."""
    return F.bround(length * dpi / 72.0).cast("long")


def crop_plans(groups: DataFrame, page_sizes: DataFrame, text_lines: DataFrame | None = None, pad: float = 5.0, dpi: int = DPI) -> DataFrame:
    """Groups with box, width_px, height_px and the file name of their crop.

    ``page_sizes``: doc_id, page_idx, width, height. ``text_lines``: doc_id, page_idx, x0, y0,
    x1, y1, gathered by page. Without a page size the plan is null.
    """
    rows = groups.join(page_sizes.select("doc_id", "page_idx", "width", "height"), ["doc_id", "page_idx"], "left")
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    if text_lines is not None:
        # In reading order, since the fold's result may depend on it.
        own = text_lines.groupBy("doc_id", "page_idx").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1"))).alias("_l"))
        rows = rows.join(own, ["doc_id", "page_idx"], "left").withColumn("_lines", F.coalesce(F.transform("_l", lambda r: F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"))), none)).drop("_l")
    else:
        rows = rows.withColumn("_lines", none)
    rows = rows.withColumn("union_box", union_box(F.col("panels"), F.col("width"), F.col("height")))
    rows = rows.withColumn("box", clamped(padded(F.col("union_box"), pad), F.col("union_box"), F.col("_lines"))).drop("_lines")
    b = F.col("box")
    return rows.withColumns({"width_px": pixels(b["x1"] - b["x0"], dpi), "height_px": pixels(b["y1"] - b["y0"], dpi), "file": F.format_string("figure-%02d.jpg", F.col("figure"))})


def ink_counts(pixels: DataFrame, dark: int = DARK) -> DataFrame:
    """doc_id, figure, edge, pos, count: dark pixels in each scan line of the padding bands.

    ``pixels``: doc_id, figure, edge, pos, value (grey, 0 to 255), a row for each pixel. A line without dark
    pixels counts 0. Counts are combined before they move.
    """
    return pixels.groupBy("doc_id", "figure", "edge", "pos").agg(F.count_if(F.col("value") < dark).alias("count"))


def clean_offsets(ink: DataFrame) -> DataFrame:
    """doc_id, figure, edge, first_clean, last_clean, outer_inked of each padding band.

    ``ink``: doc_id, figure, edge, pos, count of dark pixels in a scan line, 0 the outermost of the
    top and left. An edge only moves if its outermost line is inked; it goes to the first clean one.
    """
    clean = F.col("count") < CLEAN_PIXELS
    outer = F.when(F.col("edge").isin("top", "left"), F.min_by("count", "pos")).otherwise(F.max_by("count", "pos"))
    return ink.groupBy("doc_id", "figure", "edge").agg(F.min(F.when(clean, F.col("pos"))).alias("first_clean"), F.max(F.when(clean, F.col("pos"))).alias("last_clean"), (outer >= CLEAN_PIXELS).alias("outer_inked"))


def ink_clamped(plans: DataFrame, ink: DataFrame, dpi: int = INK_DPI) -> DataFrame:
    """Plans whose box is drawn in to the first clean scan line of each inked padding band."""
    offsets = clean_offsets(ink).groupBy("doc_id", "figure").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("first_clean", "last_clean", "outer_inked")))).alias("_bands"))
    rows = plans.join(offsets, ["doc_id", "figure"], "left")
    b, u, z = F.col("box"), F.col("union_box"), dpi / 72.0

    def low(key: str, edge: str) -> Column:
        band = F.col("_bands")[edge]
        to = F.coalesce(F.least(u[key], b[key] + band["first_clean"] / z), u[key])
        return F.when((u[key] - b[key] > 0.5) & band["outer_inked"], to).otherwise(b[key]).alias(key)

    def high(key: str, edge: str) -> Column:
        band = F.col("_bands")[edge]
        to = F.coalesce(F.greatest(u[key], u[key] + (band["last_clean"] + 1) / z), u[key])
        return F.when((b[key] - u[key] > 0.5) & band["outer_inked"], to).otherwise(b[key]).alias(key)

    return rows.withColumn("box", F.struct(low("x0", "left"), low("y0", "top"), high("x1", "right"), high("y1", "bottom"))).drop("_bands")


def text_overlaps(plans: DataFrame, content: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """doc_id, figure, i, type, area, text of text items that a crop covers by more than ``tolerance``.

    An equi-join by document and page with the overlap as a further condition.
    """
    c = content.where(F.col("type").isin(*TEXT_TYPES) & ~is_blank(F.coalesce("text", F.lit("")))).select("doc_id", "page_idx", "i", "type", "text", F.col("bbox").alias("_b"))
    both = plans.select("doc_id", "page_idx", "figure", "box", "width", "height").join(c, ["doc_id", "page_idx"])
    sx, sy, b, o = F.col("width") / GRID, F.col("height") / GRID, F.col("box"), F.col("_b")
    wide = F.greatest(F.lit(0.0), F.least(b["x1"], o[2] * sx) - F.greatest(b["x0"], o[0] * sx))
    tall = F.greatest(F.lit(0.0), F.least(b["y1"], o[3] * sy) - F.greatest(b["y0"], o[1] * sy))
    return both.withColumn("_area", wide * tall).where(F.col("_area") > tolerance).select("doc_id", "figure", "i", "type", F.bround("_area", 1).alias("area"), F.left(strip(F.col("text")), F.lit(60)).alias("text"))


def rewrite(text: Column, images: Column, file: Column, prefix: str = "") -> Column:
    """(status, text) of folding a figure's panels in a Markdown text into one image; text is null if refused.

    Refused: a panel's reference is missing, something else than panel labels stands
    between them, or references of other images do.
    """

    def pattern(h: Column) -> Column:
        return F.concat(F.lit(r"!\[\]\((?:\.\./)?images/\Q"), h, F.lit(r"\E\)"))

    def made(places: Column) -> Column:
        start, last = F.array_min(places), F.array_max(places)
        stop = last["at"] + F.length(last["ref"])
        span = F.substring(text, start["at"], stop - start["at"])

        def judged(span: Column) -> Column:
            rest = F.filter(F.transform(F.split(F.regexp_replace(span, PANEL_REFERENCE, ""), "\n", -1), strip), lambda x: x != "")
            bad = F.get(F.filter(rest, lambda x: ~x.rlike(PANEL_LABEL)), 0)
            same = F.sort_array(F.array_distinct(found(span, PANEL_REFERENCE, 1))) == F.sort_array(F.array_distinct(images))
            labels = F.when(F.size(rest) > 0, F.concat(F.array_join(rest, "\n"), F.lit("\n"))).otherwise(F.lit(""))
            folded = F.concat(F.substring(text, F.lit(1), start["at"] - 1), F.lit(f"![]({prefix}images/"), file, F.lit(")\n"), labels, F.substring(text, stop, F.length(text)))
            missing = F.exists(places, lambda p: p["at"] == 0)
            status = (
                F.when(missing, F.lit("skip: already merged or refs not found"))
                .when(bad.isNotNull(), F.concat(F.lit("skip: unexpected content between panels ("), F.left(bad, F.lit(60)), F.lit(")")))
                .when(~same, F.lit("skip: panel refs are not contiguous"))
                .otherwise(F.concat(F.lit("merged "), F.size(images).cast("string"), F.lit(" panels -> images/"), file))
            )
            return F.struct(status.alias("status"), F.when(status.startswith("merged"), folded).alias("text"))

        return let(span, judged)

    return let(F.transform(images, lambda h: F.struct(F.regexp_instr(text, pattern(h)).alias("at"), F.coalesce(F.regexp_substr(text, pattern(h)), F.lit("")).alias("ref"))), made)


def edit_of(text: Column, refs: Column, images: Column, file: Column, prefix: str = "") -> Column:
    """(status, start, stop, put): what folds a figure's panels in a text, found by the places of its references (``places`` of ``REFERENCE``).

    Refused as ``rewrite`` refuses; start, stop and put are null then.
    """
    own = F.transform(images, lambda h: F.get(F.filter(refs, lambda r: F.regexp_extract(r["match"], r"images/([^)\n]+)\)", 1) == h), 0))

    def made(own: Column) -> Column:
        missing = F.exists(own, lambda r: r.isNull())
        start, stop = F.array_min(F.transform(own, lambda r: r["start"])), F.array_max(F.transform(own, lambda r: r["stop"]))

        def judged(span: Column) -> Column:
            rest = F.filter(F.transform(F.split(F.regexp_replace(span, PANEL_REFERENCE, ""), "\n", -1), strip), lambda x: x != "")
            bad = F.get(F.filter(rest, lambda x: ~x.rlike(PANEL_LABEL)), 0)
            same = F.sort_array(F.array_distinct(found(span, PANEL_REFERENCE, 1))) == F.sort_array(F.array_distinct(images))
            status = (
                F.when(missing, GONE)
                .when(bad.isNotNull(), F.concat(F.lit("skip: unexpected content between panels ("), F.left(bad, F.lit(60)), F.lit(")")))
                .when(~same, "skip: panel refs are not contiguous")
                .otherwise(F.concat(F.lit("merged "), F.size(images).cast("string"), F.lit(" panels -> images/"), file))
            )
            labels = F.when(F.size(rest) > 0, F.concat(F.array_join(rest, "\n"), F.lit("\n"))).otherwise("")
            put, good = F.concat(F.lit(f"![]({prefix}images/"), file, F.lit(")\n"), labels), status.startswith("merged")
            return F.struct(status.alias("status"), *[F.when(good, c).alias(n) for c, n in ((start, "start"), (stop, "stop"), (put, "put"))])

        return let(F.substring(text, start + 1, stop - start), judged)

    return F.when(F.size(images) > 0, let(own, made)).otherwise(F.struct(F.lit(GONE).alias("status"), *[F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("stop", "int"), ("put", "string"))]))


def applied(text: Column, edits: Column) -> Column:
    """The text with all edits (start, stop, put; none overlaps another) made in one pass."""

    def made(e: Column) -> Column:
        before = lambda i: F.coalesce(F.get(e, i - 1)["stop"], F.lit(0))
        parts = F.transform(e, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), x["put"]))
        rest = F.substring(text, F.get(e, F.size(e) - 1)["stop"] + 1, F.length(text))
        return F.when(F.size(e) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)

    return let(F.sort_array(F.transform(edits, lambda x: F.struct(x["start"], x["stop"], x["put"]))), made)


def fold(markdown: DataFrame, figures: DataFrame, prefix: str = "") -> DataFrame:
    """doc_id, text, changed, figures (figure, status) of every text with all its figures folded.

    ``markdown``: doc_id, text. ``figures``: doc_id, figure, images (names of the panels), file. Edits are planned against the text as it
    is, references found once; one that overlaps that of a figure of a lower number is refused, as its references are gone by then. All others are made in one
    pass. A text moves once, by its document; a null text stays null, and a document without figures stays as it is.
    """
    own = figures.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("figure", "file", "images"))).alias("_own"))
    rows = markdown.select("doc_id", "text").join(own, "doc_id", "left")
    text = F.col("text")

    def planned(refs: Column) -> Column:
        return F.transform("_own", lambda f: F.struct(f["figure"].alias("figure"), edit_of(text, refs, f["images"], f["file"], prefix).alias("edit")))

    kind = "array<struct<figure:int,edit:struct<status:string,start:int,stop:int,put:string>>>"

    def settled(plans: Column) -> Column:
        """Plans in order, each one refused that overlaps one kept before it."""

        def step(kept: Column, p: Column) -> Column:
            e = p["edit"]
            clash = F.exists(kept, lambda k: (k["edit"]["start"] < e["stop"]) & (e["start"] < k["edit"]["stop"]))
            none = F.struct(F.lit(GONE).alias("status"), *[F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("stop", "int"), ("put", "string"))])
            return F.concat(kept, F.array(F.struct(p["figure"].alias("figure"), F.when(clash, none).otherwise(e).alias("edit"))).cast(kind))

        return F.aggregate(plans.cast(kind), F.array().cast(kind), step)

    plans = F.when(text.isNotNull() & F.col("_own").isNotNull(), settled(let(places(text, REFERENCE), planned)))
    rows = rows.withColumn("_plans", F.explode(F.array(F.coalesce(plans, F.array().cast(kind)))))
    out = applied(text, F.transform(F.filter("_plans", lambda p: p["edit"]["start"].isNotNull()), lambda p: p["edit"]))
    rows = rows.withColumn("_out", F.explode(F.array(out)))
    told = F.when(text.isNull(), F.transform("_own", lambda f: F.struct(f["figure"].alias("figure"), F.lit(GONE).alias("status")))).otherwise(
        F.transform("_plans", lambda p: F.struct(p["figure"].cast(figures.schema["figure"].dataType).alias("figure"), p["edit"]["status"].alias("status")))
    )
    return rows.select("doc_id", F.col("_out").alias("text"), (~F.col("_out").eqNullSafe(text)).alias("changed"), told.alias("figures"))


def references(markdown: DataFrame) -> DataFrame:
    """doc_id, file, n: how often each image is referred to. Names alone leave the texts, and counts are combined before they move."""
    names = markdown.select("doc_id", F.explode(found(F.col("text"), ANY_REFERENCE, 1)).alias("file"))
    return names.groupBy("doc_id", "file").agg(F.count("*").alias("n"))


def unresolved(markdown: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, file, n of references to images that aren't there (``files``: doc_id, file)."""
    return references(markdown).join(files.select("doc_id", "file").distinct(), ["doc_id", "file"], "left_anti")


def verify(plans: DataFrame, markdown: DataFrame, crops: DataFrame, overlaps: DataFrame, tolerance_px: int = 3, files: DataFrame | None = None) -> DataFrame:
    """doc_id, figure, status and failures of each planned figure against the Markdown and the crops that exist.

    ``markdown``: doc_id, text. ``crops``: doc_id, file, width_px, height_px. A figure whose
    panels still stand apart is left unfolded and not judged further. With ``files`` (doc_id, file) a text whose
    references don't all resolve is a failure of each of its figures. What is asked of a text is asked in its own row, for all its figures; figures then go on without it.
    """
    own = plans.groupBy("doc_id").agg(F.collect_list(F.struct("figure", "file", "width_px", "height_px", F.transform("panels", lambda p: p["img"]).alias("images"))).alias("_own"))
    met = own.join(markdown.select("doc_id", F.col("text").alias("_t")), "doc_id", "left")
    text = F.coalesce("_t", F.lit(""))

    def asked(refs: Column) -> Column:
        def one(f: Column) -> Column:
            times = (F.length(text) - F.length(F.replace(text, f["file"], F.lit("")))) / F.length(f["file"])
            return F.struct(
                *[f[c].alias(c) for c in ("figure", "file", "width_px", "height_px")],
                F.size(F.filter(f["images"], lambda h: text.contains(h))).alias("_apart"),
                edit_of(text, refs, f["images"], f["file"])["status"].startswith("merged").alias("_foldable"),
                times.alias("_refs"),
                text.contains(F.concat(F.lit("images/"), f["file"])).alias("_wired"),
            )

        return F.transform("_own", one)

    rows = met.select("doc_id", F.inline(let(places(text, REFERENCE), asked)))
    hits = overlaps.groupBy("doc_id", "figure").agg(F.count("*").alias("_hits"))
    got = crops.select("doc_id", "file", F.col("width_px").alias("_w"), F.col("height_px").alias("_h"))
    rows = rows.join(got, ["doc_id", "file"], "left").join(hits, ["doc_id", "figure"], "left")
    loose = F.lit(0)
    if files is not None:
        rows, loose = rows.join(unresolved(markdown, files).groupBy("doc_id").agg(F.count("*").alias("_loose")), "doc_id", "left"), F.coalesce("_loose", F.lit(0))
    status = (
        F.when(F.col("_foldable") & F.col("_w").isNull(), "missing image")
        .when(F.col("_foldable"), "mergeable")
        .when(F.col("_apart") > 0, "left unfolded")
        .when(~F.col("_wired"), "no reference")
        .when(F.col("_w").isNull(), "missing image")
        .otherwise("merged")
    )
    fits = F.col("_w").between(F.col("width_px"), F.col("width_px") + tolerance_px) & F.col("_h").between(F.col("height_px"), F.col("height_px") + tolerance_px)
    judged = F.col("status").isin("merged", "mergeable")
    failures = F.filter(
        F.array(
            F.when(F.col("status") == "no reference", F.lit("neither the crop nor its panels are referred to")),
            F.when(F.col("status") == "missing image", F.lit("the crop does not exist")),
            F.when(judged & ~fits, F.lit("the crop's size is not that of its box")),
            F.when(judged & (F.coalesce("_hits", F.lit(0)) > 0), F.lit("the crop covers text")),
            F.when(judged & ((F.col("_refs") != 1) | (F.col("_apart") > 0)), F.lit("references are wrong")),
            F.when(loose > 0, F.lit("references of the text do not resolve")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("status", status).select("doc_id", "figure", "status", failures.alias("failures"))


def sheet_layout(crops: DataFrame, width: float = 900.0, gap: float = 18.0, label: float = 22.0) -> DataFrame:
    """Crops with the offset and height they have on a sheet of all figures of their document."""
    tall = width * F.col("height_px") / F.col("width_px")
    order = W.partitionBy("doc_id").orderBy("file")
    before = F.coalesce(F.sum(tall + label + gap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return crops.withColumns({"sheet_y": before + gap + label, "sheet_height": tall})
