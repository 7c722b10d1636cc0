"""Sources and sinks: Markdown and binary files, layout lists, archives, term lists, credentials, remote jobs."""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions.text import is_blank, strip

from .copies import place_of
from .remote import retrying

# Size limits in bytes, layout fields, and the forms that secrets have.
LIMITS = {"agent": 10 * 1024 * 1024, "precise": 200 * 1024 * 1024}
CONTENT = "array<struct<type:string,page_idx:string,bbox:array<double>,img_path:string,table_body:string,text:string,chart_caption:string,image_caption:string,table_caption:string>>"
SECRET_KEY = r"(?<![A-Za-z0-9])sk-[A-Za-z0-9._-]{12,}"
SECRET_ASSIGNMENT = r"(?im)^\s*(?:export\s+)?[A-Z0-9_]*(?:API_KEY|TOKEN)\s*[:=]\s*[\"']?([^\s\"']+)"
TERM_LINE = r"(?U)\A\s*[-*+]\s+(.+?)\s*\z"

#: What a member of an archive may unpack to; it has to fit into a row.
MEMBER_BYTES = 1 << 30


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of all Markdown files that aren't blank, read whole."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(F.lower("path").rlike(r"\.(?:md|markdown)\z") & ~is_blank(F.col("text")))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf", mode: str = "precise") -> DataFrame:
    """path, length, content and ``refused`` (over the mode's limit) of files.

    Sizes are known before a byte is read; the content of refused files is null and is never read.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    fits = rows.where(F.col("length") <= LIMITS[mode]).select("path", "length", "content", F.lit(False).alias("refused"))
    rest = rows.where(F.col("length") > LIMITS[mode]).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("refused"))
    return fits.unionByName(rest)


def content_lists(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the folder), list (the file's name) and json of all layout lists under a path, in no order."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_content_list.json").text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(file, r"\A(.*)/[^/]*\z", 1).alias("doc_id"), F.regexp_extract(file, r"([^/]*)\z", 1).alias("list"), F.col("value").alias("json"))


def content_items(lists: DataFrame, json_col: str = "json") -> DataFrame:
    """doc_id, list, i, type, page_idx, bbox, img_path, table_body, text, captions of every item of layout lists.

    ``lists``: doc_id, list, and the JSON array. Numbers may come as text; captions as a list, as JSON
    in text, or plain. What isn't an array gives no rows.
    """
    rows = lists.select("doc_id", "list", F.posexplode(F.from_json(json_col, CONTENT)).alias("i", "_x"))
    x = F.col("_x")
    caption = F.when(x["type"] == "chart", x["chart_caption"]).when(x["type"] == "image", x["image_caption"]).when(x["type"] == "table", x["table_caption"])
    listed = F.when(F.ltrim(caption).startswith("["), F.from_json(caption, "array<string>"))
    caps = F.filter(F.coalesce(listed, F.array(caption)), lambda c: c.isNotNull() & ~is_blank(c))
    return rows.select("doc_id", "list", "i", x["type"].alias("type"), x["page_idx"].cast("int").alias("page_idx"), x["bbox"].alias("bbox"), x["img_path"].alias("img_path"), x["table_body"].alias("table_body"), x["text"].alias("text"), caps.alias("captions"))


def members_of(source: BinaryIO, most: int = MEMBER_BYTES) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(member, bytes, error) of each file of an archive that can be sought in: its list first, then each member's own range."""

    def problem(names: list[zipfile.ZipInfo]) -> str | None:
        for m in names:
            if (m.external_attr >> 16) & 0o170000 == 0o120000:
                return f"link: {m.filename}"
            if m.filename.startswith(("/", "\\")) or ".." in m.filename.replace("\\", "/").split("/"):
                return f"path leaves the archive: {m.filename}"
            if m.file_size > most:
                return f"member too large: {m.filename}"
        return None

    def unpacked(z: zipfile.ZipFile, m: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        if m.flag_bits & 1:
            return None, "encrypted member"
        try:
            return z.read(m), None
        except NotImplementedError:
            return None, "member packed by an unknown method"
        except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError, RuntimeError, ValueError):
            return None, "damaged member"

    try:
        with zipfile.ZipFile(source) as z:
            if error := problem(z.infolist()):
                yield None, None, error
                return
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, *unpacked(z, m)
    except (zipfile.BadZipFile, ValueError, EOFError):
        yield None, None, "no archive"


def _opened(files: DataFrame, used: str, others: list[str], open_: Callable[[object], BinaryIO], most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = [batch.column(c).slice(r, 1) for c in others]
                try:
                    with open_(batch.column(used)[r].as_py()) as source:
                        for member, data, error in members_of(source, most):
                            yield pa.RecordBatch.from_arrays([*same, pa.array([member], pa.string()), pa.array([data], pa.binary()), pa.array([error], pa.string())], [*others, "member", "bytes", "error"])
                except OSError as error:
                    told = f"{type(error).__name__}: {error}"[:600]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([told], pa.string())], [*others, "member", "bytes", "error"])

    kinds = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in others)
    return files.mapInArrow(run, f"{kinds}member string, bytes binary, error string")


def zip_members(files: DataFrame, content_col: str = "content", most: int = MEMBER_BYTES) -> DataFrame:
    """The rows' other columns with member, bytes and error of each file in an archive.

    An archive with a link, an absolute path or one that climbs out has a single row with the
    error and nothing else of it is read, and so has one that is no archive or has a member of
    more than ``most`` bytes when unpacked. A member that can't be read (encrypted, damaged, packed by an unknown
    method) has a row with its name and the error, without bytes; the others are read all the same. An archive is
    the largest thing held; its members are given out one by one.
    """
    return _opened(files, content_col, [c for c in files.columns if c != content_col], lambda data: io.BytesIO(data or b""), most)


def zip_members_at(files: DataFrame, path_col: str = "path", most: int = MEMBER_BYTES) -> DataFrame:
    """As ``zip_members``, for archives named by a path or address: a member is the largest thing held.

    An archive's list of members is read first, and then each member's own range, so none is held whole. An
    address that can't be opened (a null one too) is a row with the error. Paths have to be of a kind that the executors open themselves; where only Spark can read
    the files, read them whole and use ``zip_members``.
    """

    def open_(address: object) -> BinaryIO:
        if address is None:
            raise FileNotFoundError("no path")
        store, path = place_of(str(address))
        return store.open_input_file(path)

    return _opened(files, path_col, list(files.columns), open_, most)


def glossary_lines(text: Column) -> Column:
    """A JSON object as lines ``- source => target``; text that is no JSON stripped. Other JSON is an error."""

    def lines(json: Column) -> Column:
        pairs = F.map_entries(F.from_json(text, "map<string,string>"))
        rows = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("- "), p["key"], F.lit(" => "), F.coalesce(p["value"], F.lit("None")))), "\n")
        wrong = F.raise_error(F.lit("a glossary in JSON has to be an object of sources and targets")).cast("string")
        return F.when(json.isNull(), strip(text)).when(F.schema_of_variant(json).startswith("OBJECT"), rows).otherwise(wrong)

    return lines(F.try_parse_json(text))


def glossary(text: Column) -> Column:
    """(lines, sha256) of a glossary; null counts as empty and has the digest ''."""
    own = F.coalesce(glossary_lines(text), F.lit(""))
    return F.struct(own.alias("lines"), F.when(text.isNull(), F.lit("")).otherwise(F.sha2(own, 256)).alias("sha256"))


def term_list(text: Column) -> Column:
    """Terms of a bullet list, without code marks, each once in order."""
    bullets = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]", -1), lambda x: F.regexp_extract(x, TERM_LINE, 1)), lambda x: x != "")
    return F.array_distinct(F.filter(F.transform(bullets, lambda t: strip(F.regexp_replace(strip(t), r"\A`(.*)`\z", "$1"))), lambda t: t != ""))


def secret_in(text: Column) -> Column:
    """The last key in a text, else the last assignment of a key or token, else the last line that can be one."""
    keys, set_ = F.regexp_extract_all(text, F.lit(SECRET_KEY), F.lit(0)), F.regexp_extract_all(text, F.lit(SECRET_ASSIGNMENT), F.lit(1))
    rows = F.filter(F.split(text, r"\r\n|[\n\r]", -1), lambda x: ~is_blank(x) & ~F.ltrim(x).startswith("#") & ~F.ltrim(x).startswith("<!--"))
    bare = F.filter(F.transform(rows, lambda x: F.regexp_replace(strip(x), "\\A[`\"']+|[`\"']+\\z", "")), lambda x: (F.length(x) >= 12) & ~x.rlike(r"(?U)\s"))
    return F.coalesce(F.try_element_at(keys, F.lit(-1)), F.try_element_at(set_, F.lit(-1)), F.try_element_at(bare, F.lit(-1)))


def first_secret(*sources: Column) -> Column:
    """The first of several places that has one; blank counts as none."""
    return F.coalesce(*[F.when(~is_blank(s), strip(s)) for s in sources])


def is_token(c: Column) -> Column:
    """Whether a text can be a service's token: twelve characters or more and no white space."""
    return F.coalesce((F.length(c) >= 12) & ~c.rlike(r"(?U)\s"), F.lit(False))


def run_jobs(files: DataFrame, client: Callable[[str, bytes], tuple[str, str | None, str | None]], id_col: str = "path", content_col: str = "content", tries: int = 3) -> DataFrame:
    """id, state, result, error of sending each file to a remote service.

    ``client`` gets name and bytes and gives back state, result and error; it has its own
    secrets, and is what this library leaves to its user. It is called up to ``tries`` times where it
    fails in passing; an exception after that is the state ``failed``.
    """
    kind = files.schema[id_col].dataType.simpleString()
    send = retrying(client, tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    got.append(send(str(name), data or b""))
                except Exception as e:  # noqa: BLE001  the service's failure is a result
                    got.append(("failed", None, str(e)[:600]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[k] for g in got], pa.string()) for k in range(3)]], [id_col, "state", "result", "error"])

    return files.select(id_col, content_col).mapInArrow(run, f"`{id_col}` {kind}, state string, result string, error string")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as a table; a reader sees all of a write or nothing of it."""
    docs.write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(path)
