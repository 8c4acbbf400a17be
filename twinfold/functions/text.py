"""Column functions on text."""

from __future__ import annotations

import html.entities
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regex class body.
BLANK = r"\s\x0B   -     　﻿"


#: Its characters.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{BLANK}]", c, re.ASCII))


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{BLANK}]")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def locale(c: Column) -> Column:
    """Language code of a book to locale: jp is ja, Chinese variants in lower case, nothing is und."""
    low = F.lower(c)
    return F.when(low.isin("jp", "ja"), "ja").when(low.isin("zh", "zh-cn", "zh-tw", "ko"), low).when(F.coalesce(c, F.lit("")) == "", "und").otherwise(c)


def replacement(new: str, groups: int = 99, names: tuple[str, ...] | None = None) -> str:
    """A replacement written with $&, $<name>, $1 to $99 and $$, as Java writes it.

    Of two digits the first counts alone when the pattern has fewer groups; a number of no group,
    and any other $, stands for itself. So does $<name> when the pattern has no ``names`` at all;
    else an unknown name stands for nothing.
    """

    def java(m: re.Match) -> str:
        if m["all"]:
            return "$0"
        if m["name"]:
            if names is None or m["name"] in names:
                return f"${{{m['name']}}}"
            return "" if names else f"\\$<{m['name']}>"
        if m["digits"]:
            for d in (m["digits"], m["digits"][0]):
                if 0 < int(d) <= groups:
                    rest = m["digits"][len(d) :]
                    return f"${int(d)}" + (f"\\{rest}" if rest else "")
            return f"\\${m['digits']}"
        return "\\\\" if m[0] == "\\" else "\\$"

    return re.sub(r"(?P<all>\$&)|\$<(?P<name>\w+)>|\$(?P<digits>\d\d?)|\$\$|\$|\\", java, new)


def rounded(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + 0.5)


def has_mojibake(c: Column) -> Column:
    # What Shift_JIS text looks like when read as another charset.
    return c.rlike("�|縺|繧|繝|縲|繧｢|繝ｪ|繧ｹ")


def mime_type(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    # Fixed values.
    known = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), ext), F.lit("application/octet-stream"))


def resolve_path(base: Column, href: Column) -> Column:
    """``href`` seen from the folder of the document ``base``: ``..`` and ``.`` are followed; empty steps, also that of a leading /, are dropped."""
    folder = F.slice(F.split(base, "/"), F.lit(1), F.size(F.split(base, "/")) - 1)
    steps = F.filter(F.concat(folder, F.split(href, "/")), lambda x: (x != "") & (x != "."))
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")


def decode_entities(c: Column) -> Column:
    """Named entities of HTML 4 and &apos;, and numeric ones of any plane, in one pass; numbers of no character give U+FFFD, unknown names stay."""
    names = html.entities.name2codepoint | {"apos": ord("'")}
    known = F.from_json(F.lit(json.dumps({name: chr(code) for name, code in names.items()})), "map<string,string>")

    def numeric(digits: Column, base: int) -> Column:
        number = F.when(F.length(F.ltrim(digits, F.lit("0"))) < 8, F.conv(digits, base, 10).cast("long"))
        real = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def decoded(x: Column) -> Column:
        name = F.regexp_extract(x, "^&(#?[xX]?)([0-9a-zA-Z]+);$", 2)
        hexadecimal, decimal = x.rlike("^&#[xX][0-9a-fA-F]+;$"), x.rlike("^&#[0-9]+;$")
        return F.when(~x.startswith("&"), x).when(decimal, numeric(name, 10)).when(hexadecimal, numeric(name, 16)).otherwise(F.coalesce(known[F.substring(x, 2, F.length(x) - 2)], x))

    pieces = F.regexp_extract_all(c, F.lit("&[#0-9a-zA-Z]+;|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(c)


def paragraph_texts(text: Column, delimiter: str = r"\n{2,}", crlf: bool = True) -> Column:
    """The paragraphs of a text: split at the delimiter, inner line breaks become one space, empties dropped."""
    raw = F.coalesce(text, F.lit(""))
    raw = F.replace(raw, F.lit("\r\n"), F.lit("\n")) if crlf else raw
    raw = F.replace(raw, F.lit("\r"), F.lit("")) if delimiter == "\n" else raw
    parts = F.split(raw, delimiter)
    if delimiter != "\n":  # such parts hold no line break
        parts = F.transform(parts, lambda p: F.regexp_replace(F.replace(p, F.lit("\r"), F.lit("")), r"[ \t]*\n+[ \t]*", " "))
    return F.array_remove(F.transform(parts, trim), "")
