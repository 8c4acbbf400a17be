"""Markup pages to text blocks, images, headings; bytes to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.text import decode_entities, mime_type, resolve_path, trim

# Tags that end a line of the fallback rule.
BLOCK_TAGS = ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "li", "td", "th")
#: Tokens of a page; a script or style element is one token. What is not closed ends with the page, so that a page is read once, in linear time.
TOKEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<[^>]*(?:>|\z)|[^<]+"


def attribute(token: Column, name: str) -> Column:
    """The value of an attribute of a tag, '' if it has none."""
    return F.regexp_extract(token, rf"""(?is)[\s"']{name}\s*=\s*["']([^"']*)["']""", 1)


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """(key, pos, token, tag, close, text) of each page's body, in order; comments, scripts, styles and ruby readings dropped."""
    out = pages.select(key, *(keep or []), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.when(F.col("token").startswith("<"), F.lower(F.regexp_extract("token", r"^</?\s*([A-Za-z][A-Za-z0-9:]*)", 1)))
    out = out.withColumn("tag", tag).withColumn("close", F.col("token").startswith("</"))
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a reading ends with its end tag or that of its ruby, or where another part of the ruby begins
    ruby = F.last(F.when(F.col("tag").isin("rt", "rb", "rp") | ((F.col("tag") == "ruby") & F.col("close")), (F.col("tag") == "rt") & ~F.col("close")), ignorenulls=True).over(run)
    body = F.min(F.when((F.col("tag") == "body") & ~F.col("close"), F.col("pos"))).over(Window.partitionBy(key))
    out = out.withColumn("reading", F.coalesce(ruby, F.lit(False))).withColumn("body", F.coalesce(body, F.lit(-1)))
    out = out.where(r"pos > body and not reading and token not rlike '(?is)^(<!|<script|<style|<\\?)'").drop("reading", "body")
    return out.withColumn("text", F.when(~F.col("token").startswith("<"), F.regexp_replace("token", r"[ \t]*[\n\r]+[ \t]*", " ")))


def parted(t: DataFrame, key: str) -> DataFrame:
    """Rows of ``t`` with the part that they are in: ``flat`` where that is given, else once for each div with the flag ``here`` around them, where it begins.

    Divs are paired by depth. Each row is dealt to the levels of flagged divs that are open there; at
    a level, the last one that began holds it. So rows grow with the result only, without comparing
    rows with divs.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, shuts = (F.col("tag") == "div") & F.col("open"), (F.col("tag") == "div") & F.col("close")
    t = t.withColumn("level", F.sum(flag(opens) - flag(shuts)).over(run) + flag(shuts))
    pairs = Window.partitionBy(key, F.when(opens | shuts, F.col("level"))).orderBy("pos")
    t = t.withColumn("shut", flag(shuts) * F.coalesce(F.lag(flag(opens & F.col("here"))).over(pairs), F.lit(0)))
    t = t.withColumn("around", F.sum(flag(F.col("here")) - F.col("shut")).over(run).cast("int"))
    none = F.array().cast("array<int>")
    content = F.col("text").isNotNull() | F.col("image").isNotNull()
    levels = F.when(F.col("flat").isNotNull(), F.when(content, F.array(F.lit(0))).otherwise(none)).when(F.col("here"), F.array("around")).when(content & (F.col("around") > 0), F.sequence(F.lit(1), F.col("around"))).otherwise(none)
    dealt = t.select("*", F.explode(levels).alias("at"))
    begun = F.last(F.when(F.col("here"), F.col("pos")), ignorenulls=True).over(Window.partitionBy(key, "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("part", F.coalesce("flat", begun.cast("long"))).where(content)


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html", path: Column | None = None, members: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """(key, block_idx, text, image_ids) of each page by the first rule that applies.

    Rules: three or more div of class bs, bs1, ...; p elements when any has text or an image; div of
    class calibre2 or with parag in its class; else lines between br and block tags, images being
    lines of their own. A p ends at its end tag, the next p or a block tag; what stands in several
    divs of the rule is in the block of each. A block's images are its img, then its SVG images, each
    source once, resolved against ``path`` if that is given; those that are not in ``members`` (path
    and the columns ``on`` of the pages) are dropped. Blocks without text and images are dropped.
    """
    on = on or []
    rows = pages.select(key, html, *([path.alias("_path")] if path is not None else []), *[F.col(c).alias(f"_on_{c}") for c in on if c != key])
    carried = [c for c in rows.columns if c not in (key, html)]
    t = tokens(rows, key, html, carried)
    names = F.split(trim(attribute(F.col("token"), "class")), r"\s+")
    t = t.withColumn("open", F.col("tag").isNotNull() & ~F.col("close") & ~F.col("token").endswith("/>"))
    div = F.col("open") & (F.col("tag") == "div")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    yes = lambda c: F.coalesce(c, F.lit(False))
    t = t.withColumn("bs", yes(div & F.exists(names, lambda c: c.rlike(r"^bs\d*$")))).withColumn("cal", yes(div & F.exists(names, lambda c: (c == "calibre2") | c.contains("parag"))))
    source = F.when(F.col("tag") == "img", attribute(F.col("token"), "src")).when(F.col("tag").isin("image", "svg:image"), F.coalesce(F.nullif(attribute(F.col("token"), "href"), F.lit("")), attribute(F.col("token"), "xlink:href")))
    source = F.when(~F.col("close") & ~((F.col("tag") != "img") & source.rlike("(?i)^https?:")), F.nullif(decode_entities(source), F.lit("")))
    t = t.withColumn("image", source)
    page = Window.partitionBy(key)
    run = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col("tag").isin(*BLOCK_TAGS)
    t = t.withColumn("p_part", F.sum(flag(ends)).over(run)).withColumn("br_part", 2 * F.sum(flag(ends | (F.col("tag") == "br") | F.col("image").isNotNull())).over(run) - flag(F.col("image").isNotNull()))
    t = t.withColumn("in_p", yes(F.last(F.when(ends, F.col("open") & (F.col("tag") == "p")), ignorenulls=True).over(run)))
    content = F.col("image").isNotNull() | (F.col("text").isNotNull() & (trim(decode_entities(F.col("text"))) != ""))
    t = t.withColumn("n_bs", F.sum(flag(F.col("bs"))).over(page)).withColumn("n_p", F.sum(flag(F.col("in_p") & content)).over(page)).withColumn("n_cal", F.sum(flag(F.col("cal"))).over(page))
    t = t.withColumn("rule", F.when(F.col("n_bs") >= 3, "bs").when(F.col("n_p") > 0, "p").when(F.col("n_cal") > 0, "cal").otherwise("br"))
    rule = F.col("rule")
    flat = F.when(rule == "p", F.when(F.col("in_p"), F.col("p_part"))).when(rule == "br", F.col("br_part"))
    t = t.where("rule <> 'p' or in_p").withColumn("flat", flat.cast("long")).withColumn("here", F.when(rule == "bs", F.col("bs")).otherwise((rule == "cal") & F.col("cal")))
    sorted_ = lambda *c: F.array_sort(F.collect_list(F.when(F.col(c[-1]).isNotNull(), F.struct(*c))))
    found = parted(t.withColumn("svg", F.col("tag") != "img"), key).groupBy(key, "part").agg(
        F.array_join(F.transform(sorted_("pos", "text"), lambda x: x["text"]), "").alias("text"), F.array_distinct(F.transform(sorted_("svg", "pos", "image"), lambda x: x["image"])).alias("image_ids"), *[F.first(c).alias(c) for c in carried],
    ).withColumn("text", trim(decode_entities(F.col("text"))))
    if path is not None:
        found = found.withColumn("image_ids", F.transform("image_ids", lambda x: resolve_path(F.col("_path"), x)))
    if members is not None:
        # a row for each image, and one for a block without
        own = [F.col(c if c == key else f"_on_{c}").eqNullSafe(F.col(f"_there_{c}")) for c in on]
        there = members.select(*[F.col(c).alias(f"_there_{c}") for c in on], F.col("path").alias("_there")).distinct()
        images = found.select("*", F.posexplode_outer("image_ids").alias("_at", "_image")).join(there, [*own, F.col("_image") == F.col("_there")], "left")
        kept = F.array_sort(F.collect_list(F.when(F.col("_there").isNotNull(), F.struct("_at", "_image"))))
        found = images.groupBy(key, "part").agg(F.first("text").alias("text"), F.transform(kept, lambda x: x["_image"]).alias("image_ids"))
    found = found.where("text <> '' or size(image_ids) > 0")
    return found.withColumn("block_idx", F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1).select(key, "block_idx", "text", "image_ids")


def image_refs(pages: DataFrame, path: Column, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, image_idx, asset_id, mime_type): img sources, then SVG images; each raw source once, resolved against the page's path."""
    tags = lambda name: F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(rf"(?is)<{name}\b[^>]*(?:>|\z)"), F.lit(0))
    given = lambda some: F.filter(some, lambda x: x != "")
    img = given(F.transform(tags("img"), lambda x: attribute(x, "src")))
    svg = given(F.transform(tags("image"), lambda x: F.coalesce(F.nullif(attribute(x, "href"), F.lit("")), attribute(x, "xlink:href"))))
    raw = F.array_distinct(F.concat(img, F.filter(svg, lambda h: ~h.rlike("(?i)^https?:"))))
    out = pages.select(key, path.alias("path"), F.posexplode(raw).alias("image_idx", "raw")).withColumn("asset_id", resolve_path(F.col("path"), F.col("raw")))
    return out.select(key, "image_idx", "asset_id", mime_type(F.col("asset_id")).alias("mime_type"))


def charset(content: Column) -> Column:
    """Charset named in the first 8 KiB; without a name, shift_jis."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    name = F.regexp_extract(head, r"""(?i)charset\s*=\s*["']?\s*([^"'\s;>]+)""", 1)
    # Fixed values.
    alias = {"shift_jis": "shift_jis", "shiftjis": "shift_jis", "sjis": "shift_jis", "windows_31j": "cp932", "cp932": "cp932", "euc_jp": "euc_jp", "utf_8": "utf-8", "utf8": "utf-8"}
    known = F.element_at(F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]), F.replace(F.lower(name), F.lit("-"), F.lit("_")))
    return F.when(name == "", "shift_jis").otherwise(F.coalesce(known, name))


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with charset, text and error; bytes of an unknown charset give an error and no text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("text string, error string")
    def read(data, name):
        import pandas as pd

        out = []
        for d, n in zip(data, name, strict=True):
            try:
                out.append((bytes(d).decode(n) if d is not None else None, None))
            except LookupError:
                out.append((None, f"unsupported encoding: {n}"))
            except UnicodeDecodeError as e:
                out.append((None, f"bytes not in {n} at {e.start}"))
        return pd.DataFrame(out, columns=["text", "error"])

    named = files.withColumn("charset", charset(F.col(content)))
    # UTF-8 stays in the JVM; other charsets go through Arrow batches
    plain = named.where("charset = 'utf-8'").withColumn("text", F.decode(F.col(content), "UTF-8")).withColumn("error", F.lit(None).cast("string"))
    other = named.where("charset <> 'utf-8'").withColumn("r", read(F.col(content), F.col("charset"))).withColumn("text", F.col("r.text")).withColumn("error", F.col("r.error")).drop("r")
    return plain.unionByName(other)


def between_markers(html: Column, start: str, end: str) -> Column:
    """The trimmed text between two fixed markers; null when either is missing."""
    a, b = F.instr(html, start), F.instr(html, end)
    return F.when((a > 0) & (b > 0), trim(F.substring(html, a + len(start), F.greatest(b - a - len(start), F.lit(0)))))


def headings(pages: DataFrame, pattern_id: str, pattern_label: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, heading_idx, anchor, label) from two patterns that match the same places."""
    both = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(pattern_id), F.lit(1)).alias("anchor"), F.regexp_extract_all(F.col(html), F.lit(pattern_label), F.lit(1)).alias("label"))
    return pages.select(key, F.posexplode(both).alias("heading_idx", "h")).select(key, "heading_idx", "h.anchor", "h.label")


def meta_content(html: Column, name: str) -> Column:
    got = F.regexp_extract(html, rf'(?i)<meta\s+name="{name}"\s+content="([^"]*)"', 1)
    return F.when(html.rlike(rf'(?i)<meta\s+name="{name}"\s+content="'), trim(got))
