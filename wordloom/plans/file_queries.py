"""Contract queries of the file sources: given tables are written as files
into a fresh folder under the checkpoint folder and read back (S1, S2), or
stand for files as they are (S8, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import path_exists, remove_dir, shared_dir
from ..sources import files, sinks
from ..tables import table
from .common import register


# One text file per document, found again by a recursive pattern -------------
@register("text_folder_corpus", """
select source, text from documents where text is not null
""")
def text_folder_corpus(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    # a file name holds the source as hex: any source gives a name, null too
    name = F.concat(F.coalesce(_hex_name("source"), F.lit("null")), F.lit("-"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    path = sinks.write_item_files(d.select(name.alias("name"), "text"), shared_dir(spark, "texts"), "name", "text")
    back = files.text_file_corpus(spark, path, "**/*.txt")
    return back.select(_source_of("path", "/(s[0-9A-F]*|null)-[0-9]+[.]txt$").alias("source"), "text")


def _hex_name(column: str):
    """A file name part for any string: s and its bytes in hex."""
    return F.concat(F.lit("s"), F.hex(F.encode(F.col(column), "UTF-8")))


def _source_of(path: str, pattern: str):
    source = F.regexp_extract(path, pattern, 1)
    return F.when(source != "null", F.decode(F.unhex(F.substring(source, 2, 1_000_000)), "UTF-8"))


# Documents as files of a folder per source, copied, and the copies read again ------
#: The files of so many portions of the documents are made, copied and removed one after the other, as a small file
#: takes a whole block of the disk: two files of every document at once would be several times the input.
PORTIONS = 8


@register("processed_copies", """
select doc_id, source, text from documents where text is not null and regexp_matches(text, '\\S')
""")
def processed_copies(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    name = F.concat(F.coalesce(_hex_name("source"), F.lit("null")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    out = shared_dir(spark, "copies")
    for i in range(PORTIONS):
        portion = d.where(F.pmod(F.xxhash64("doc_id", "source", "text"), F.lit(PORTIONS)) == i).select(name.alias("name"), "text")
        path = sinks.write_item_files(portion, shared_dir(spark, "files"), "name", "text")
        sinks.write_processed_copies(files.text_file_corpus(spark, path, "**/*.txt"), out, path)
        if path_exists(spark, path):
            remove_dir(spark, path)
    back = files.text_file_corpus(spark, out, "**/*_processed.txt")
    return back.select(F.regexp_extract("path", "/(-?[0-9]+|none)(~[0-9]+)?_processed[.]txt$", 1).try_cast("bigint").alias("doc_id"),
                       _source_of("path", "/(s[0-9A-F]*|null)/[^/]*$").alias("source"), "text")


# CSV files per source and block of documents, the text column in two places -----
BLOCK_DOCS = 4096


def _csv_files(spark, sf):
    """(source, block, text) of every CSV file: block is doc_id div 4096, so a
    large source is many files; the layout goes by source and block."""
    path = shared_dir(spark, "csv")
    # a folder name for any source: null, empty and special characters too
    name = _hex_name("source")
    d = table(spark, sf, "documents").where("text is not null and text <> ''") \
        .withColumn("name", F.coalesce(name, F.lit("null"))).withColumn("block", F.floor(F.col("doc_id") / BLOCK_DOCS))
    d = d.repartition("name", "block").sortWithinPartitions("name", "block", "doc_id")
    odd = F.pmod(F.xxhash64("name", "block"), F.lit(2)) == 1
    options = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true"}
    d.where(odd).select("name", "block", "doc_id", "text").write.partitionBy("name", "block").options(**options).csv(f"{path}/first")
    d.where(~odd).select("name", "block", F.col("text").alias("Text"), "lang").write.partitionBy("name", "block").options(**options).csv(f"{path}/second")
    c = files.csv_corpus(spark, path, "**/*.csv")
    return c.select(_source_of("path", "name=(s[0-9A-F]*|null)/").alias("source"),
                    F.regexp_extract("path", "block=(-?[0-9]+)/", 1).try_cast("bigint").alias("block"), "text")


@register("csv_corpora", """
select source, string_agg(text, chr(10) order by doc_id) as text from documents
where text is not null and text <> '' group by source
""")
def csv_corpora(spark, sf):
    # one row per source is what the SQL asks for: the files of a source are put together last
    blocks = _csv_files(spark, sf).groupBy("source").agg(F.array_sort(F.collect_list(F.struct(
        F.col("block").isNull().alias("last"), "block", "text"))).alias("t"))
    return blocks.select("source", F.array_join("t.text", "\n").alias("text"))


# S2, compared per file: no row holds a whole source
@register("csv_corpora_files", """
select source, (doc_id // 4096)::bigint as block, string_agg(text, chr(10) order by doc_id) as text from documents
where text is not null and text <> '' group by all
""")
def csv_corpora_files(spark, sf):
    return _csv_files(spark, sf)


# Pages as files: the url is the path, the encoded html the content -------
@register("page_admission", r"""
select page_id, case when not regexp_matches(url, '\.html$') then 'extension' when html is null or html = '' then 'empty'
  when not regexp_matches(html, '\S') then 'blank' end as reason, md5(html) as text_md5
from pages
""")
def page_admission(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"),
                                         F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    a = files.admit_files(p.withColumn("length", F.octet_length("content")), [".html"])
    return a.select("page_id", "reason", F.md5(files.decode_with_fallback(F.col("content"))).alias("text_md5"))


# S8 with declared types: pages, documents, turns as JSON and event properties stand for files ---
_TYPE_SQL = r"""case when regexp_matches(t, '(?i)^[ \t\r\n]*<(!doctype html|html|head|body)[\s>]') then 'text/html'
    when regexp_matches(t, '^[ \t\r\n]*<\?xml') then 'application/xml'
    when regexp_matches(t, '^[ \t\r\n]*[{]') and regexp_matches(t, '[}][ \t\r\n]*$') then 'application/json'
    when regexp_matches(t, '^[ \t\r\n]*\[') and regexp_matches(t, '\][ \t\r\n]*$') then 'application/json' else 'text/plain' end"""


@register("declared_types", rf"""
with f as (select 'page' as kind, page_id as id, html as t from pages union all select 'document', doc_id, text from documents
  union all select 'turn', conv_id * 1000 + turn, '{{"role":"' || role || '"}}' from conversations
  union all select 'event', event_id, props from events)
select kind, id, case when t is null then null else {_TYPE_SQL} end as mime_type,
  case when t is null or t = '' then 'empty' when {_TYPE_SQL} not in ('text/plain', 'application/json', 'text/csv') then 'mimetype'
    when not regexp_matches(t, '\S') then 'blank' end as reason
from f
""")
def declared_types(spark, sf):
    rows = [("pages", "page", "page_id", F.col("html")), ("documents", "document", "doc_id", F.col("text")),
            ("conversations", "turn", "conv_id", F.to_json(F.struct("role"))), ("events", "event", "event_id", F.col("props"))]
    parts = []
    for name, kind, key, text in rows:
        number = F.col("conv_id") * 1000 + F.col("turn") if name == "conversations" else F.col(key)
        parts.append(table(spark, sf, name).select(F.lit(kind).alias("kind"), number.cast("bigint").alias("id"), F.lit("f.txt").alias("path"),
                                                   F.encode(text, "UTF-8").alias("content")))
    f = parts[0]
    for p in parts[1:]:
        f = f.unionByName(p)
    f = f.withColumn("mime_type", files.mime_type(F.col("content"), F.col("path"))) \
         .withColumn("length", F.coalesce(F.octet_length("content"), F.lit(0)))
    return files.admit_files(f, mimetypes=files.ALLOWED_MIMETYPES).select("kind", "id", "mime_type", "reason")
