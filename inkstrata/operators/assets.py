"""Files that documents refer to: references, resolution, rewritten paths, and what a slim output keeps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Images as what is before a destination, it and what is after it (as in ``functions.markdown``, for Python), what isn't a local path, and where its query or fragment is.
IMAGE = re.compile(r"(!\[[^\]\n]*\]\()(<[^>\n]+>|[^\s)]+)([^)\n]*\))", re.ASCII)
HTML = re.compile(r"""(<(?ai:img)\b[^>]*\b(?ai:src\s*=\s*))("[^"]*"|'[^']*')""")
REMOTE = r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#|/)"
_REMOTE = re.compile(REMOTE)
_REST = re.compile(r"[?#][^\n\r\x85\u2028\u2029]*\Z")
_ENDING = re.compile(r"[^?#]*([^\n\r\x85\u2028\u2029]*)\Z")


_CODED = re.compile("(?:%[0-9A-Fa-f]{2})+")
_UNSAFE = re.compile(r"[^A-Za-z0-9_.\-~/:@]+")
# A corpus has few different runs of such characters, so each is coded about once in a worker.
_decoded = lru_cache(4096)(unquote)
_encoded = lru_cache(4096)(quote)


def steps_to(path: str) -> str | None:
    """Path without . and .. and empty steps; null if it leaves the folder it starts from. ``normalised`` for Python."""
    steps = [s for s in path.split("/") if s and s != "."]
    if ".." in steps:
        given, steps = steps, []
        for s in given:
            if s != "..":
                steps.append(s)
            elif steps:
                steps.pop()
            else:
                return None
    return "/".join(steps) or None


def local_references(text: str) -> dict[str, str | None]:
    """The different local destinations of a text's Markdown images, then of its HTML images, each with its path."""
    raws = dict.fromkeys([d.lstrip("<").rstrip(">") for d in IMAGE.split(text)[2::4]])
    raws.update(dict.fromkeys([d[1:-1] for d in HTML.split(text)[2::3]]))
    out = {}
    for raw in raws:
        if not _REMOTE.match(raw):
            plain = _REST.sub("", raw) if "?" in raw or "#" in raw else raw
            plain = _CODED.sub(lambda m: _decoded(m[0]), plain) if "%" in plain else plain
            if plain:
                out[raw] = steps_to(plain)
    return out


def led_to(text: str, new: dict[str, str]) -> str:
    """The text with each image's destination replaced by what ``new`` has for it, if anything."""

    def image(d: str) -> str:
        to = new.get(d.removeprefix("<").removesuffix(">"))
        return d if to is None else f"<{to}>" if d[0] == "<" else to

    pieces = IMAGE.split(text)
    pieces[2::4] = [image(d) for d in pieces[2::4]]
    pieces = HTML.split("".join(pieces))
    pieces[2::3] = [d if (to := new.get(d[1:-1])) is None else d[0] + to + d[0] for d in pieces[2::3]]
    return "".join(pieces)


def from_output(raw: str, path: str, up: str) -> str:
    """A reference to a path that lies ``up`` from the output; query and fragment stay."""
    ending = _ENDING.match(raw) if "?" in raw or "#" in raw else None
    return _UNSAFE.sub(lambda m: _encoded(m[0]), f"{up}/{path}") + (ending[1] if ending else "")


def is_local(raw: Column) -> Column:
    return raw.isNotNull() & ~raw.rlike(REMOTE)


def normalised(path: Column) -> Column:
    """Path without . and .. and empty steps; null if it leaves the folder it starts from."""
    none = F.lit(None).cast("array<string>")
    steps = F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(acc.isNull(), none).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(s))),
    )
    # Most paths have no such steps and are as they should be.
    return F.when(path.rlike(r"(?:\A|/)\.{0,2}(?:/|\z)"), F.when(F.size(folded) > 0, F.array_join(folded, "/"))).otherwise(path)


def asset_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw, path: the different local references of each document; path is null outside its folder."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _listed([[] if t is None else list(local_references(t).items()) for t in texts.to_pylist()])

    refs = F.arrow_udf(run, "array<struct<raw:string,path:string>>")(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(refs).alias("_r")).select("doc_id", "_r.raw", "_r.path")


def _listed(found: list[list[tuple]], *kinds: tuple[str, pa.DataType]) -> pa.ListArray:
    """Each text's references as structs of raw, path and ``kinds``."""
    flat, kinds = [x for own in found for x in own], (("raw", pa.string()), ("path", pa.string()), *kinds)
    columns = [pa.array([x[k] for x in flat], t) for k, (_, t) in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, found), initial=0), pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in kinds]))


def resolved_references(docs: DataFrame, files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``resolve`` of ``asset_references``, worked out beside the text: only paths travel, and the references stay with their document."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, owns in batches:
            pairs = zip(texts.to_pylist(), map(set, _lists(owns)), strict=True)
            yield _listed([[] if t is None else [(raw, path, path in own) for raw, path in local_references(t).items()] for t, own in pairs], ("resolved", pa.bool_()))

    refs = F.arrow_udf(run, "array<struct<raw:string,path:string,resolved:boolean>>")(text_col, F.coalesce("_own", F.array().cast("array<string>")))
    rows = beside(docs, files.groupBy("doc_id").agg(F.collect_set("path").alias("_own")), id_col)
    return rows.select(F.col(id_col).alias("doc_id"), F.explode(refs).alias("_r")).select("doc_id", "_r.raw", "_r.path", "_r.resolved")


def _lists(arrays: pa.ListArray) -> Iterator[list]:
    """Lists of an array that has no nulls."""
    values, ends = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy().tolist()
    return (values[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False))


def beside(docs: DataFrame, by_doc: DataFrame, id_col: str, how: str = "left") -> DataFrame:
    """``docs`` with what each has in ``by_doc``: this grows beyond what its columns' sizes say, so it is never broadcast."""
    return docs.join(by_doc.withColumnRenamed("doc_id", id_col).hint("merge"), id_col, how)


def resolve(references: DataFrame, files: DataFrame) -> DataFrame:
    """References with ``resolved``: whether the document has such a file (doc_id, path)."""
    there = files.select("doc_id", "path", F.lit(True).alias("_there")).distinct()
    return references.join(there, ["doc_id", "path"], "left").select("doc_id", "raw", "path", F.coalesce("_there", F.lit(False)).alias("resolved"))


def copy_plan(references: DataFrame, files: DataFrame, present: DataFrame) -> DataFrame:
    """doc_id, path of the different resolved files that aren't present with the same bytes (doc_id, path, sha256)."""
    wanted = resolve(references, files).where("resolved").select("doc_id", "path").distinct().join(files, ["doc_id", "path"])
    return wanted.join(present, ["doc_id", "path", "sha256"], "left_anti").select("doc_id", "path")


def shared_paths(docs: DataFrame, references: DataFrame, up: str = "..", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with resolved references led to the source folder, ``up`` from the output, and shared_assets.

    Query and fragment of a reference stay. ``references`` are those of ``resolve``. Where nothing else needs them, ``shared_files`` is cheaper.
    """
    by_doc = references.where("resolved").groupBy("doc_id").agg(F.collect_list(F.struct("raw", "path")).alias("_own"))
    return _shared(docs, by_doc, lambda text, own: {x["raw"]: x["path"] for x in own}, up, id_col, text_col)


def shared_files(docs: DataFrame, files: DataFrame, up: str = "..", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shared_paths`` of all references that lead to one of the document's ``files`` (doc_id, path).

    References are found, resolved and rewritten where the text is, so no text is made or read twice, and only paths travel
    to it: a document's text and its different paths are the largest thing held.
    """
    by_doc = files.groupBy("doc_id").agg(F.collect_set("path").alias("_own"))

    def resolved(text: str, own: list[str]) -> dict[str, str]:
        there = set(own)
        return {raw: path for raw, path in local_references(text).items() if path in there}

    return _shared(docs, by_doc, resolved, up, id_col, text_col)


def _shared(docs: DataFrame, by_doc: DataFrame, resolved: Callable[[str, list], dict[str, str]], up: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with text and shared_assets by what ``resolved`` (raw: path) makes of a text and the document's ``_own`` in ``by_doc``."""

    def moved(text: str | None, own: list | None) -> tuple[str | None, int]:
        if text is None or not own:
            return text, 0
        refs = resolved(text, own)
        return led_to(text, {raw: from_output(raw, path, up) for raw, path in refs.items()}), len(set(refs.values()))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, own in batches:
            got = [moved(t, o) for t, o in zip(texts.to_pylist(), own.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())], ["text", "shared_assets"])

    rows = beside(docs, by_doc, id_col).withColumn("_m", F.arrow_udf(run, "text string, shared_assets int")(text_col, "_own"))
    return rows.withColumns({text_col: F.col("_m")["text"], "shared_assets": F.coalesce(F.col("_m")["shared_assets"], F.lit(0))}).drop("_m", "_own")


def main_markdown(files: DataFrame) -> DataFrame:
    """doc_id, path: the ``full.md`` nearest the top, else the nearest Markdown file; ties by path."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(F.lower(name).endswith(".md"))
    order = F.struct((name != "full.md").alias("other"), F.size(F.split("path", "/")).alias("depth"), F.col("path").alias("path"))
    return rows.groupBy("doc_id").agg(F.min(order).alias("_o")).select("doc_id", "_o.path")


def slim_plan(files: DataFrame) -> DataFrame:
    """doc_id, path, dest, action of every file: main Markdown, content lists and images are kept, all else dropped.

    ``files``: doc_id, path, sha256. Of files that go to one place, equal ones are kept once (the rest ``same``);
    different ones are a ``conflict``. Decided by counts per place, which are combined before they move.
    """
    name = F.element_at(F.split("path", "/"), -1)
    main = main_markdown(files).select("doc_id", "path", F.lit(True).alias("_main"))
    rows = files.join(main, ["doc_id", "path"], "left")
    dest = (
        F.when(F.col("_main"), "full.md")
        .when(name.endswith("_content_list.json"), name)
        .when(F.col("path").rlike(r"(?:\A|/)images/."), F.concat(F.lit("images/"), F.regexp_extract("path", r"(?:\A|/)images/(.+)\z", 1)))
    )
    rows = rows.withColumn("dest", dest).drop("_main")
    first = F.min(F.struct(F.size(F.split("path", "/")).alias("depth"), F.col("path").alias("path")))
    places = rows.where("dest is not null").groupBy("doc_id", "dest").agg(F.count_distinct("sha256").alias("_n"), first["path"].alias("_first"))
    action = F.when(F.col("dest").isNull(), "drop").when(F.col("_n") > 1, "conflict").when(F.col("path") == F.col("_first"), "keep").otherwise("same")
    return rows.join(places, ["doc_id", "dest"], "left").select("doc_id", "path", "dest", action.alias("action"))
