"""File sources: text-file corpora (S1), CSV text columns (S2), file admission
(S8) and decoding with a fallback (S9).  Each is a Spark reader plus
built-in expressions, or, for the whole files of a tree of folders, tasks that
list and read them; nothing is read on the driver."""

from __future__ import annotations

import logging
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as tx
from ..session import shared_dir

log = logging.getLogger(__name__)

# --- fixed values: admission ----------------------------------------------
ALLOWED_EXTENSIONS = [".txt", ".json", ".jsonl", ".csv"]
ALLOWED_MIMETYPES = ["text/plain", "application/json", "text/csv"]
# --- fixed values: names of files that no compression codec reads -----------
PLAIN_ENDINGS = (*ALLOWED_EXTENSIONS, ".md", ".tsv", ".html", ".xml", ".log")
# ---------------------------------------------------------------------------


def _empty_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path STRING, text STRING")


def _glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ``**`` stands for any number of
    folders, ``*`` and ``?`` stay inside one name."""
    out = []
    for part in pattern.split("/"):
        out.append("(?:[^/]+/)*" if part == "**" else _name_regex(part) + "/")
    return "".join(out).removesuffix("/")


def _name_regex(part: str) -> str:
    special = {"*": "[^/]*", "?": "[^/]"}
    return "".join(special.get(c) or re.escape(c) for c in part)


def _joined_parts(df: DataFrame) -> DataFrame:
    """A scan of very many small files has a partition for every few of them;
    joined to some for each core, a task reads many files."""
    return df.coalesce(16 * df.sparkSession.sparkContext.defaultParallelism)


def _read_pattern(spark: SparkSession, root: str, pattern: str, reader) -> DataFrame | None:
    """``reader(options, target, keep)``: keep is a condition on the file path
    that a ``**`` pattern needs beside the recursive listing, else None."""
    keep = None
    if "**" in pattern:
        head = pattern.split("**", 1)[0].rstrip("/")
        opts = {"recursiveFileLookup": "true", "pathGlobFilter": pattern.split("/")[-1]}
        if pattern.endswith("**"):
            opts.pop("pathGlobFilter")
            pattern += "/*"
        target = os.path.join(root, head) if head else root
        # after a plain **/ the name filter says it all: no condition on every path in the driver
        if not re.fullmatch(r"\*\*/[A-Za-z0-9_.*-]*[A-Za-z0-9_.-]", pattern):
            keep = F.col("_metadata.file_path").rlike("/" + _glob_regex(pattern.strip("/")) + "$")
    else:
        opts, target = {}, os.path.join(root, pattern)
    try:
        df = reader(opts, target, keep)
        df.schema  # noqa: B018 - force path resolution
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def _whole_files(spark: SparkSession, pattern: str):
    """A reader for ``_read_pattern``: (path, text) of whole files.  The text
    reader copies the Hadoop configuration for each file, under one lock of the
    process, to find a file's codec; files whose ending has none are read as
    bytes, which are the same text, and only others by the text reader."""
    path = F.col("_metadata.file_path")
    plain = path.rlike(f"(?:{'|'.join(map(re.escape, PLAIN_ENDINGS))})$")

    def reader(opts, target, keep):
        all_names = keep is None
        keep = F.lit(True) if keep is None else keep
        text = F.col("content").cast("string").alias("text")
        # the name filter of a recursive listing holds for every file; another
        # pattern may name a folder, whose files have any ending
        if "pathGlobFilter" in opts and pattern.endswith(PLAIN_ENDINGS):
            tree = _tree_files(spark, target, opts["pathGlobFilter"]) if all_names else None
            return tree if tree is not None else _joined_parts(spark.read.options(**opts).format("binaryFile").load(target)
                                                               .where(keep).select(path.alias("path"), text))
        as_bytes = spark.read.options(**opts).format("binaryFile").load(target).where(keep)
        # the text() keyword wins over options(), so pass wholetext there
        as_text = spark.read.options(**opts).text(target, wholetext=True).where(keep)
        return _joined_parts(as_bytes.where(plain).select(path.alias("path"), text).union(
            as_text.where(~plain).select(path.alias("path"), F.col("value").alias("text"))))

    return reader


#: Up to so many files Spark's own listing, which the driver holds, is used.
TREE_FILES = 10_000
#: Files and bytes of a task that reads whole files, up to 16 tasks a core; files and bytes of an Arrow batch.
_TASK_FILES, _TASK_BYTES, _BATCH_FILES, _BATCH_BYTES = 100, 1 << 24, 1000, 1 << 22


def _tree_files(spark: SparkSession, target: str, name: str) -> DataFrame | None:
    """(path, text) of the files below the folder ``target`` whose names match
    ``name``, the same as Spark's recursive listing finds: no hidden and no
    empty ones.  Spark keeps the status of every file in the driver; here tasks
    list the folders, level by level, into a table that says which files there
    are, and tasks read them.  None if pyarrow does not reach the folder, or
    if there are TREE_FILES or fewer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(target)
    where = where.getFileSystem(conf).makeQualified(where)
    plain, uri = where.toString(), re.sub("^file:/+", "file:/", where.toUri().toString())
    if re.search(r"[][*?{}\\]", plain) or not _arrow_reaches(plain):
        return None
    base, schema = shared_dir(spark, "listing"), "folder string, name string, size long"
    matches = _name_regex(name)
    level, folders = 0, spark.createDataFrame([("", None, None)], schema)
    cores = spark.sparkContext.defaultParallelism
    while True:
        folders.mapInArrow(lambda batches: _list_folders(batches, plain, matches), schema).write.parquet(f"{base}/{level}")
        below = spark.read.schema(schema).parquet(f"{base}/{level}").where("name is null")
        n = below.count()
        if not n:
            break
        folders, level = below.repartition(min(n, 16 * cores)), level + 1
    listed = spark.read.schema(schema).parquet(*[f"{base}/{i}" for i in range(level + 1)]).where("name is not null")
    n, size = listed.agg(F.count("name"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n <= TREE_FILES:
        return None
    tasks = max(1, min(n, 16 * cores, max(n // _TASK_FILES, size // _TASK_BYTES) + 1))
    read = listed.repartition(tasks).mapInArrow(lambda batches: _read_files(batches, plain, uri), "path string, content binary")
    return read.select("path", F.col("content").cast("string").alias("text"))


def arrow_fs(path: str):
    """(file system of pyarrow, path in it) of a path or URI."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _arrow_reaches(path: str) -> bool:
    from pyarrow import ArrowException, fs
    try:
        if not path.startswith("file:") and re.search("[^!-$&-~]", path):   # a URI would need these encoded
            return False
        own, top = arrow_fs(path)
        return own.get_file_info(top).type == fs.FileType.Directory
    except (ArrowException, OSError, ImportError):
        return False


def _hidden(name: str) -> bool:
    """Names that Spark's listings leave out."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
            or name.startswith(".") or name.endswith("._COPYING_"))


def _entries(own, folder: str):
    """(name, is a folder, size) of what a folder holds."""
    from pyarrow import fs
    if isinstance(own, fs.LocalFileSystem):     # one by one, however many there are
        with os.scandir(folder) as found:
            for x in found:
                try:
                    yield x.name, x.is_dir(), x.stat().st_size
                except FileNotFoundError:       # a link to nothing, or gone meanwhile
                    continue
    else:
        for x in own.get_file_info(fs.FileSelector(folder)):
            yield x.base_name, x.type == fs.FileType.Directory, x.size


def _list_folders(batches, root: str, matches: str):
    """(folder, name, size) of the files in each folder, folders being relative
    to ``root``; a folder in it is a row without name."""
    import pyarrow as pa
    own, top = arrow_fs(root)
    names = ["folder", "name", "size"]
    kinds = (pa.string(), pa.string(), pa.int64())
    for b in batches:
        for folder in b.column(0).to_pylist():
            out = []
            for name, is_folder, size in _entries(own, f"{top.rstrip('/')}/{folder}"):
                if _hidden(name):
                    continue
                if is_folder:
                    out.append((f"{folder}{name}/", None, None))
                elif size and re.fullmatch(matches, name) and not (name.startswith("_") and "=" not in name):   # no _metadata file
                    out.append((folder, name, size))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def _read_files(batches, root: str, uri: str):
    """(path, content) of listed files; the path is a URI as in ``_metadata.file_path``."""
    import pyarrow as pa
    own, top = arrow_fs(root)
    paths, contents, held = [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for b in batches:
        for folder, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with own.open_input_file(f"{top.rstrip('/')}/{folder}{name}") as f:
                contents.append(f.readall())
            paths.append(f"{uri.rstrip('/')}/{_uri_part(folder + name)}")
            held += len(contents[-1])
            if held >= _BATCH_BYTES or len(paths) >= _BATCH_FILES:
                yield batch()
                paths, contents, held = [], [], 0
    if paths:
        yield batch()


def _uri_part(path: str) -> str:
    """A path as java.net.URI writes it."""
    import unicodedata
    from urllib.parse import quote
    if re.fullmatch(r"[\w!$&'()*+,\-./:;=@~]*", path, re.A):
        return path
    return "".join(c if re.match(r"[\w!$&'()*+,\-./:;=@~]", c, re.A) or c >= "\x80" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
                   else quote(c, safe="") for c in path)


# S1 ---------------------------------------------------------------------------
def text_file_corpus(spark: SparkSession, root: str,
                     patterns: str | list[str] = "*.txt") -> DataFrame:
    """One row per file: (path, text).  A bare string is one pattern; not
    recursive unless the pattern has ``**``; a file matched by two patterns
    is read twice; nothing found gives an empty frame and a warning."""
    pats = [patterns] if isinstance(patterns, str) else list(patterns)
    parts = [p for p in (_read_pattern(spark, root, pat, _whole_files(spark, pat)) for pat in pats) if p is not None]
    if not parts:
        log.warning("no files found in %s for %s", root, pats)
        return _empty_corpus(spark)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# S2 ---------------------------------------------------------------------------
#: Characters from which on the rows of a file go into a new part.
PART_CHARS = 1 << 20
_CSV = {"multiLine": "true", "quote": '"', "escape": '"'}


def csv_corpus(spark: SparkSession, root: str, pattern: str = "*.csv",
               text_column: str | None = None) -> DataFrame:
    """One document per CSV file: (path, text) with the non-null values of its
    text column (first column named ``text`` in any case, or ``text_column``)
    joined by newline in file order; a file without such a column gives null.
    A whole file is one row here; ``csv_corpus_parts`` has bounded rows."""
    parts = csv_corpus_parts(spark, root, pattern, text_column)
    return parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p")).select(
        "path", F.when(F.get("p.text", F.lit(0)).isNotNull(), F.array_join("p.text", "\n")).alias("text"))


def csv_corpus_parts(spark: SparkSession, root: str, pattern: str = "*.csv",
                     text_column: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """As ``csv_corpus`` in rows of a bounded size: (path, part, text), the parts
    of a file numbered from 0; joined by newline in that order they are the
    document.  A part ends with the value that takes it to ``part_chars``
    characters.  A file without the column, or without a value in it, is one
    part of null.

    Files are parsed as streams where they are read, quoted newlines in values
    and headers included: no file is held whole, whatever its size, and no
    list of files is made.  Two passes: the header records tell how many
    columns there are at most and where text columns stand; then each file's
    own header chooses among those."""
    wanted = (text_column or "text").lower()

    def heads(opts, target, keep):
        df = spark.read.options(**opts).option("lineSep", "\n").text(target)
        df = df if keep is None else df.where(keep)
        return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    lines = _read_pattern(spark, root, pattern, heads)
    known = None if lines is None else lines.where("start = 0").mapInArrow(
        lambda batches: _header_records(batches, wanted), "columns int, at int").agg(
        F.max("columns").alias("columns"), F.sort_array(F.collect_set("at")).alias("at")).first()
    if known is None or known["columns"] is None:
        log.warning("no CSV files found in %s for %s", root, pattern)
        return spark.createDataFrame([], "path STRING, part INT, text STRING")
    # a file without a text column is still known by its first column
    at = known["at"] or [0]

    def cells(opts, target, keep):
        schema = ", ".join(f"c{i} string" for i in range(known["columns"]))
        df = spark.read.options(**opts, **_CSV).schema(schema).csv(target)
        df = df if keep is None else df.where(keep)
        return df.select(F.col("_metadata.file_path").alias("path"), *[f"c{i}" for i in at])

    return _read_pattern(spark, root, pattern, cells).mapInArrow(
        lambda batches: _file_parts(batches, wanted, part_chars), "path string, part int, text string")


def _header_records(batches, wanted: str):
    """(columns, place of the text column or null) of the first record of each
    file; lines come in file order, a record goes on while a quote is open."""
    import csv
    import pyarrow as pa
    path, held, done = None, "", False

    def record():
        cells = next(csv.reader([held.removesuffix("\r")], strict=False), [])
        cells[:1] = [c.removeprefix("\ufeff") for c in cells[:1]]
        return len(cells), next((i for i, c in enumerate(cells) if c.lower() == wanted), None)

    for b in batches:
        out = []
        for p, line in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if p != path:
                if path is not None and not done and held:
                    out.append(record())
                path, held, done = p, "", False
            if done or not held and not line.strip("\r\ufeff"):
                continue
            held = f"{held}\n{line}" if held else line
            if held.count('"') % 2 == 0:
                out.append(record())
                done = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*out)], ["columns", "at"])
    if path is not None and not done and held:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in record()], ["columns", "at"])


def _file_parts(batches, wanted: str, part_chars: int):
    """Parts of each file from its records in order, the first being the header."""
    import pyarrow as pa
    path, column, part, held, size = None, None, 0, [], 0
    out = []

    def close(last: bool):
        """A part is due when it is full, or at the end of a file that has no other."""
        if held or last and not part:
            out.append((path, part, "\n".join(held) if held else None))

    for b in batches:
        names = b.column(0).to_pylist()
        cells = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
        for r, p in enumerate(names):
            if p != path:
                if path is not None:
                    close(True)
                path, part, held, size = p, 0, [], 0
                column = next((i for i, c in enumerate(cells) if (c[r] or "").removeprefix("\ufeff").lower() == wanted), None)
                continue
            value = cells[column][r] if column is not None else None
            if value is None:
                continue
            held.append(value)
            size += len(value) + 1
            if size >= part_chars:
                close(False)
                part, held, size = part + 1, [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string()))],
                                             ["path", "part", "text"])
            out = []
    if path is not None:
        close(True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string()))],
                                         ["path", "part", "text"]) if out else pa.RecordBatch.from_pylist([], pa.schema(
                                             [("path", pa.string()), ("part", pa.int32()), ("text", pa.string())]))


# S8 / S9 --------------------------------------------------------------------
_BOM = "EFBBBF"


def _latin1_plausible(content: Column) -> Column:
    """Narrowed encoding guess: every byte >= 0x80 is an accented Latin-1
    letter (0xC0-0xFE, not 0xD7 or 0xF7)."""
    pairs = F.regexp_extract_all(F.hex(content), F.lit("(..)"), 1)
    return ~F.exists(pairs, lambda b: b.rlike("^([89AB][0-9A-F]|D7|F7|FF)$"))


def decode_with_fallback(content: Column) -> Column:
    """UTF-8 (BOM dropped) when valid; else ISO-8859-1 when plausible;
    else UTF-8 with replacement characters."""
    has_bom = F.hex(F.substring(content, 1, 3)) == F.lit(_BOM)
    body = F.when(has_bom, F.substring(content, 4, 2147483647)).otherwise(content)
    return (F.when(F.is_valid_utf8(body), F.decode(body, "UTF-8"))
             .when(_latin1_plausible(body), F.decode(body, "ISO-8859-1"))
             .otherwise(F.make_valid_utf8(body)))


def read_binary(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``binaryFile`` scan; no file is left out for its size (``admit_files``
    can tell too large ones)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)


#: Leading bytes of formats that are no text, and the type that they tell.
SIGNATURES = {
    "25504446": "application/pdf", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif",
    "474946383961": "image/gif", "504B0304": "application/zip", "1F8B": "application/gzip", "28B52FFD": "application/zstd",
    "425A68": "application/x-bzip2", "FD377A585A00": "application/x-xz", "7F454C46": "application/x-elf",
    "504152310000": "application/vnd.apache.parquet", "7B5C727466": "application/rtf",
}


def mime_type(content: Column, path: Column) -> Column:
    """The type that a file's content tells, in built-in expressions: a known
    signature in the leading bytes; ``application/octet-stream`` with a NUL byte
    in the first kilobyte; by its first characters (byte order mark and white
    space passed over) HTML, XML or JSON (an object or array that closes, or
    lines of objects); else ``text/csv`` for a .csv file and ``text/plain``.
    Null content gives null."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.lit(None).cast("string")
    for signature, kind in sorted(SIGNATURES.items()):
        found = F.when(head.startswith(signature), kind).otherwise(found)
    # all bytes stay apart as Latin-1 characters, whatever the text's encoding
    start = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    start = F.regexp_replace(start, "^\u00ef\u00bb\u00bf", "")
    end = F.regexp_extract(F.decode(F.substring(content, -64, 64), "ISO-8859-1"), r"([\]}])[ \t\r\n]*$", 1)
    first = F.regexp_extract(start, r"^[ \t\r\n]*([\[{])", 1)
    return (F.when(content.isNull(), None).when(found.isNotNull(), found)
             .when(start.contains("\x00"), "application/octet-stream")
             .when(start.rlike(r"(?i)^[ \t\r\n]*<(!doctype html|html|head|body)[\s>]"), "text/html")
             .when(start.rlike(r"^[ \t\r\n]*<\?xml"), "application/xml")
             .when((first == "{") & (end == "}") | (first == "[") & (end == "]"), "application/json")
             .when(F.lower(path).endswith(".csv"), "text/csv").otherwise("text/plain"))


def admit_files(df: DataFrame, extensions: list[str] | None = None,
                max_bytes: int | None = None, mimetypes: list[str] | None = None) -> DataFrame:
    """Adds ``admitted`` and ``reason`` to a binaryFile frame.

    Admitted when the extension is allowed, the size is within ``max_bytes``
    (None: any size), the content's type is one of ``mimetypes`` (None: any;
    ALLOWED_MIMETYPES are the declared ones) and the whole content decodes
    (UTF-8, else the fallback of S9) to a non-blank text.
    """
    exts = [e.lower() for e in (extensions or ALLOWED_EXTENSIONS)]
    ext = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]+)$", 1))
    content = F.col("content")
    text = (F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8"))
             .when(_latin1_plausible(content), F.decode(content, "ISO-8859-1")))
    too_large = F.lit(False) if max_bytes is None else F.col("length") > F.lit(max_bytes)
    reason = (F.when(~ext.isin(*exts), F.lit("extension"))
               .when(too_large, F.lit("size"))
               .when(F.col("length") == 0, F.lit("empty"))
               .when(F.lit(False) if mimetypes is None else ~mime_type(content, F.col("path")).isin(*mimetypes), F.lit("mimetype"))
               .when(text.isNull(), F.lit("encoding"))
               .when(~tx.is_not_blank(text), F.lit("blank")))
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def decoded_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """S8 + S9: admitted files with their decoded text (path, length, text)."""
    b = admit_files(read_binary(spark, root, pattern))
    return (b.where("admitted")
             .select("path", "length", decode_with_fallback(F.col("content")).alias("text")))
