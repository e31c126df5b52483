"""Text columns: stripping, summaries, token estimates, names, URLs and path predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that end a word in the Unicode sense, as a character class.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space (in the Unicode sense) at both ends."""
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


def uniform_lines(text: Column) -> Column:
    """Line ends as single line feeds, without a byte-order mark."""
    return F.regexp_replace(F.regexp_replace(text, "^\\x{feff}", ""), r"\r\n?", "\n")


def word_count(text: Column) -> Column:
    """Words between white space; mapped to blanks first, since a pattern of one character is several times as fast as the class."""
    return F.regexp_count(F.translate(text, WHITE_CHARACTERS, " " * len(WHITE_CHARACTERS)), F.lit("[^ ]+"))


def token_estimate(text: Column) -> Column:
    """White-space separated words times 4, integer-divided by 3; null stays null."""
    return F.floor(word_count(text) * 4 / 3).cast("int")


def first_line(text: Column, most: int = 200) -> Column:
    """First line without white space around it, at most ``most`` characters."""
    return F.substring(strip(F.substring_index(text, "\n", 1)), 1, most)


def first_sentence(text: Column, most: int = 200) -> Column:
    """Up to the first period before a blank, else before a line end, else the first ``most`` characters."""
    blank, line = F.locate(". ", text), F.locate(".\n", text)
    return F.when(blank > 1, F.substring(text, F.lit(1), blank)).when(line > 1, F.substring(text, F.lit(1), line)).otherwise(F.substring(text, 1, most))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def safe_filename(name: Column, most: int = 100) -> Column:
    """Letters, digits, dot, underscore and hyphen stay; anything else becomes an underscore."""
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{Nd}._-]", "_"), 1, most)


def is_url(path: Column) -> Column:
    return path.rlike("(?i)^https?://")


def url_host(path: Column) -> Column:
    """Host in lower case without port; null for other paths."""
    return F.nullif(F.lower(F.regexp_extract(path, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def normal_url(path: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(path, "#.*$", ""), "/+$", "")


def url_kind(path: Column) -> Column:
    """``class_ref``, ``tutorial`` or ``guide`` by the path of a page."""
    below = F.lower(F.regexp_extract(path, r"(?i)^https?://[^/?#]+([^?#]*)", 1))
    return F.when(below.contains("/classes/") | below.contains("/class_"), "class_ref").when(below.contains("/tutorial") | below.contains("/getting_started"), "tutorial").otherwise("guide")


def path_suffix(path: Column) -> Column:
    """Lower-case suffix without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def path_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def included(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Regular expressions searched in the path; exclusion wins, an empty inclusion keeps all."""
    keep = reduce(lambda a, b: a | b, [path.rlike(p) for p in include]) if include else F.lit(True)
    drop = reduce(lambda a, b: a | b, [path.rlike(p) for p in exclude]) if exclude else F.lit(False)
    return keep & ~drop


def outside_directories(path: Column, directories: Sequence[str]) -> Column:
    """No folder of the path is one of ``directories``; the file name doesn't count."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in directories])) if directories else F.lit(True)


def title_of(text: Column, path: Column) -> Column:
    """First heading of level 1 to 3, else the first non-blank line (100 characters), else the file name in words."""
    lines = F.filter(F.transform(F.split(uniform_lines(text), "\n"), strip), lambda line: line != "")
    headings = F.filter(lines, lambda line: line.rlike(r"^#{1,3}\s+\S"))
    heading = strip(F.regexp_replace(F.try_element_at(headings, F.lit(1)), r"^#{1,3}\s+", ""))
    plain = F.substring(F.try_element_at(F.filter(lines, lambda line: ~line.startswith("#")), F.lit(1)), 1, 100)
    return F.coalesce(heading, plain, F.initcap(F.translate(path_stem(path), "_-", "  ")))
