"""Where sentences end: a break table over classes of characters, by locale.

A text is cut after every run of end marks with the closers and blanks behind it. Whether a sentence
ends at a cut follows from the classes on its two sides, by the public rules for sentence boundaries
of Unicode text: nothing breaks before a comma or another end mark; !, ? and full-width marks break;
a dot does not within a number (3.14), within an abbreviation (U.S.A), before a word in lower case, or
after an abbreviation of the locale (Dr.); other dots break. Closing quotes and brackets stay with
their sentence; unlike there, opening ones begin the next. In SQL classes of one side are regular
expressions without look-around; in Spark one expression with look-around marks the ends. A cut needs
its two neighbours only, so a text is marked in one pass, in time linear to its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinfold.functions.text import trim

# Classes of characters, as regex class bodies. Dots, other end marks, closers, blanks, marks that carry a sentence on.
DOT = r".\x{2024}\x{FE52}\x{FF0E}"
END = r"!?\x{3002}\x{FF61}\x{FF01}\x{FF1F}\x{203C}\x{2047}-\x{2049}\x{061F}\x{06D4}\x{0964}\x{0965}"
CLOSE = r"\x22\x27)\]}\x{BB}\x{2019}\x{201D}\x{203A}\x{3009}\x{300B}\x{300D}\x{300F}\x{3011}\x{FF09}\x{FF3D}\x{FF5D}"
SPACE = r"\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
GO_ON = r",:;\x{3001}\x{FF0C}\x{FF1A}\x{FF1B}\x{2013}\x{2014}\-"

#: An end mark, as a class that most characters leave after one comparison.
MARK = rf"[.!?[\x{{061F}}-\x{{FF61}}&&[{DOT}{END}]]]"
#: One piece between two cuts.
PIECE = f"[^{DOT}{END}]*[{DOT}{END}]+[{CLOSE}]*[{SPACE}]*|[^{DOT}{END}]+"
#: What the left side of a cut may be; the group is the word of an abbreviation.
ENDS_IN_DOT, BARE_DOT, LETTER_DOT, WORD_DOT = rf"[{DOT}][{CLOSE}]*[{SPACE}]*\z", rf"[{DOT}]\z", rf"[\p{{Lu}}\p{{Ll}}\p{{Lt}}][{DOT}]\z", rf"(?:^|\PL)(\pL{{1,8}})\.[{CLOSE}]*[{SPACE}]*\z"
#: What the right side may begin with.
CARRIES_ON, DIGIT, UPPER, LOWER = f"^[{GO_ON}{DOT}{END}]", r"^\p{Nd}", r"^[\p{Lu}\p{Lt}]", rf"^[^\pL{DOT}{END}]*\p{{Ll}}"

# Words that a dot follows inside a sentence, by language. Of g. and B. the letters before don't matter (e.g., z.B.).
ABBREVIATIONS = {
    "en": ("dr", "mr", "mrs", "ms", "prof", "rev", "hon", "gen", "col", "capt", "lt", "sgt", "st", "jr", "sr", "vs", "cf", "fig", "vol", "pp", "ca", "approx", "dept", "est", "g"),
    "de": ("dr", "prof", "hr", "fr", "st", "nr", "abb", "bd", "bzw", "ca", "evtl", "geb", "ggf", "inkl", "sog", "str", "tel", "vgl", "b"),
    "fr": ("dr", "m", "mm", "mme", "mlle", "prof", "st", "ste", "av", "bd", "cf", "env", "ex", "fig", "vol", "pp"),
    "es": ("dr", "dra", "sr", "sra", "srta", "ud", "uds", "prof", "av", "cf", "fig", "núm", "pág", "vol", "pp"),
    "it": ("dott", "sig", "sigg", "prof", "avv", "ing", "cfr", "fig", "pag", "vol"),
}


def any_case(word: str) -> str:
    """A regex of what becomes ``word`` in lower case, also the Kelvin sign."""
    return "".join(f"[{c}{c.upper()}]" if c != "k" else "[kK\\x{212A}]" for c in word)


def end_pattern(words: tuple[str, ...] = ()) -> str:
    """A run of end marks with the closers and blanks behind it, where a sentence ends; ``words`` are abbreviations.

    The classes and rules of ``breaks_sql`` in one expression: what is behind the run is looked at
    before closers and blanks, what is ahead after them. A run is tried from its first mark only.
    Java looks back by code points only if the pattern holds one beyond the basic plane: the last group does, and matches nothing.
    """
    short = rf"(?<!(?<!\pL)(?:{'|'.join(map(any_case, words))})\.)" if words else ""
    dot = rf"(?<=[{DOT}])(?!\p{{Nd}})(?!(?<=[\p{{Lu}}\p{{Ll}}\p{{Lt}}][{DOT}])[\p{{Lu}}\p{{Lt}}]){short}[{CLOSE}]*+[{SPACE}]*+(?![^\pL{DOT}{END}]*+\p{{Ll}})"
    return rf"{MARK}(?<![{DOT}{END}][{DOT}{END}])[{DOT}{END}]*+(?:(?<=[{END}])[{CLOSE}]*+[{SPACE}]*+|{dot})(?![{GO_ON}{DOT}{END}])(?:|{chr(0x10000)})"


def sentence_texts(text: Column, lang: Column | None = None) -> Column:
    """The sentences of a paragraph, with their end marks; blank ones dropped. Abbreviations are those of ``lang``."""
    whole = F.coalesce(text, F.lit(""))
    marked = lambda words=(): F.regexp_replace(whole, end_pattern(words), "$0\x01")
    found = marked()
    if lang is not None:
        code = F.lower(F.substring(lang, 1, 2))
        for known, words in ABBREVIATIONS.items():
            found = F.when(code == known, marked(words)).otherwise(found)
    return F.array_remove(F.transform(F.split(found, "\x01"), trim), "")


def breaks_sql(left: str, right: str, lang: str) -> str:
    """Whether a sentence ends between two neighbouring pieces, in SQL."""
    at = lambda side, rule: f"regexp_matches({side}, '{rule.replace(chr(39), chr(39) * 2)}')"
    words = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in some)}]" for k, some in ABBREVIATIONS.items())
    short = f"coalesce(list_contains(CASE lower(substr({lang}, 1, 2)) {words} END, lower(regexp_extract({left}, '{WORD_DOT}', 1))), false)"
    inside = f"({at(right, DIGIT)} AND {at(left, BARE_DOT)}) OR ({at(right, UPPER)} AND {at(left, LETTER_DOT)}) OR {at(right, LOWER)} OR {short}"
    return f"CASE WHEN {right} IS NULL OR {at(right, CARRIES_ON)} THEN false WHEN NOT {at(left, ENDS_IN_DOT)} THEN true ELSE NOT ({inside}) END"
