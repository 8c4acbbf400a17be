"""Zipped books to their pages in reading order.

Only the listing of a zip's members runs in Python; container, manifest and spine are read and
joined as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.operators.shared import checkpointed, text_batches
from twinfold.sources import markup
from twinfold.sources.paragraphs import numbered

#: Bytes of files that are sent together.
HELD = 4 << 20


def members(books: DataFrame, key: str = "book_id", content: str = "content") -> DataFrame:
    """(key, path, data): the files inside each zip, one row each; bytes that aren't a zip give no rows."""
    kind = dict(books.dtypes)[key]

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        def made(k, names, data):
            return pa.RecordBatch.from_arrays([pa.repeat(k, len(names)), pa.array(names, pa.string()), pa.array(data, pa.binary())], [key, "path", "data"])

        for batch in batches:
            for k, content_ in zip(*batch.columns, strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content_.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                names, data, held = [], [], 0
                for name in archive.namelist():
                    if not name.endswith("/"):
                        names.append(name)
                        data.append(archive.read(name))
                        held += len(data[-1])
                    if held > HELD:
                        yield made(k, names, data)
                        names, data, held = [], [], 0
                if names:
                    yield made(k, names, data)

    return text_batches(books.select(key, content)).mapInArrow(run, f"{key} {kind}, path string, data binary")


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"""(?s)(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def tags(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<(?:\w+:)?{name}(?=[\s/>])([^>]*)>"), F.lit(1))


def spine(found: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, spine_pos, path, xhtml): pages that the spine lists, in its order.

    Navigation pages, unknown ids, and what isn't .xhtml or .html are left out; so are pages that
    the zip lacks or that are empty. The files are kept in the shared folder, so that no zip is opened
    twice; places are numbered before the texts are joined.
    """
    text = checkpointed(found.select(key, "path", F.decode("data", "UTF-8").alias("text")))
    roots = text.where("path = 'META-INF/container.xml'").select(key, attribute(F.get(tags(F.col("text"), "rootfile"), F.lit(0)), "full-path").alias("path")).where("path is not null")
    package = text.join(roots, [key, "path"]).withColumn("folder", F.regexp_extract("path", "^(.*/)[^/]*$", 1))
    item = package.select(key, "folder", F.posexplode(tags(F.col("text"), "item")).alias("at", "tag")).select(key, "folder", "at", attribute(F.col("tag"), "id").alias("id"), attribute(F.col("tag"), "href").alias("href"), attribute(F.col("tag"), "properties").alias("properties"))
    nav = F.coalesce(F.col("properties").contains("nav"), F.lit(False)) | F.col("href").rlike(r"(?i)(?:^|/)(?:nav|toc)\.x?html$")
    item = item.where("id is not null and href is not null")
    navs = item.where(nav).select(key, "id").distinct()
    # of items that share an id, the last counts
    last = item.groupBy(key, "id").agg(F.max_by(F.struct("folder", "href"), "at").alias("i")).select(key, "id", "i.folder", "i.href")
    ref = package.select(key, F.posexplode(tags(F.col("text"), "itemref")).alias("at", "tag")).select(key, "at", attribute(F.col("tag"), "idref").alias("id"))
    listed = ref.join(navs, [key, "id"], "left_anti").join(last, [key, "id"]).where(F.col("href").rlike(r"\.x?html$")).withColumn("path", F.concat("folder", "href"))
    there = text.where("text <> ''")
    place = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    pages = listed.select(key, "at", "path").join(there.select(key, "path"), [key, "path"]).select(key, "path", place.alias("spine_pos"))
    return pages.join(there, [key, "path"]).select(key, "spine_pos", "path", F.col("text").alias("xhtml"))


def book_paragraphs(pages: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, para_idx, text, image_ids) of spine pages: blocks of each page, numbered through the book; images are paths in the book."""
    named = pages.select(F.concat_ws("|", F.lpad(F.col("spine_pos").cast("string"), 9, "0"), F.col(key).cast("string")).alias("page_id"), key, "spine_pos", "path", F.col("xhtml").alias("html"))
    found = markup.blocks(named, path=F.col("path")).join(named.select("page_id", key, "spine_pos"), "page_id")
    return numbered(found, key, ["spine_pos", "block_idx"], "para_idx").select(key, "para_idx", "text", "image_ids")
