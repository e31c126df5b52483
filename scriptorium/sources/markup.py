"""Markup columns to markdown, as chains of regular expressions in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# The admonitions of the RST format, in its own order.
ADMONITIONS = ("attention", "caution", "danger", "error", "hint", "important", "note", "tip", "warning")
# Rewriting rules in order, as (pattern, replacement).
RST_RULES = [
    (r"(?m)^\.\. _[^:\n]+:[ \t]*\n?", ""),
    (rf"(?m)^\.\. ({'|'.join(ADMONITIONS)}|seealso)::[ \t]*([^\n]*)", "**$1:** $2"),
    (r"(?m)^\.\. (?:image|figure|toctree|contents|raw|include|only|meta)::[^\n]*\n(?:[ \t]+[^\n]*\n|[ \t]*\n(?=[ \t]+\S))*", ""),
    (r":(?:ref|doc|class|meth|func|attr|mod|term):`([^`<\n]+?)\s*<[^>`\n]*>`", "$1"),
    (r":(?:ref|doc|class|meth|func|attr|mod|term):`~?([^`\n]+)`", "$1"),
    (r"(?m)^\.\. [\w-]+::[^\n]*\n?", ""),
    (r"(?m)^([=~^\"'#*+-])\1{2,}[ \t]*\n([^\n]+)\n\1{3,}[ \t]*$", "# $2"),
    (r"(?m)^(\S[^\n]*)\n={3,}[ \t]*$", "# $1"),
    (r"(?m)^(\S[^\n]*)\n-{3,}[ \t]*$", "## $1"),
    (r"(?m)^(\S[^\n]*)\n[~]{3,}[ \t]*$", "### $1"),
    (r"(?m)^(\S[^\n]*)\n\^{3,}[ \t]*$", "#### $1"),
    (r"(?m)^(\S[^\n]*)\n([\"'`+*#:._])\2{2,}[ \t]*$", "#### $1"),
    (r"``([^`\n]+)``", "`$1`"),
    (r"\n{3,}", "\n\n"),
]
HTML_RULES = [
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(script|style|nav|footer|header|noscript|template)\b[^>]*>.*?</\1\s*>", ""),
    (r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", "\n\u0001$1 $2\n"),
    (r"(?is)<li\b[^>]*>", "\n- "),
    (r"(?is)<(?:br|/?p|/?div|/?section|/?article|/?tr|/?table|/?ul|/?ol|/?pre|/?blockquote)\b[^>]*>", "\n"),
    (r"(?s)<[^>]*>", ""),
    ("\u00011 ", "# "), ("\u00012 ", "## "), ("\u00013 ", "### "), ("\u00014 ", "#### "), ("\u00015 ", "##### "), ("\u00016 ", "###### "),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&amp;", "&"),
    (r"(?m)^[ \t]+|[ \t]+$", ""),
    (r"\n{2,}", "\n"),
]


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda column, rule: F.regexp_replace(column, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def rst_to_markdown(text: Column) -> Column:
    """Labels and images dropped, admonitions and references to text, underlined headings to levels 1 to 4."""
    return T.strip(_apply(T.uniform_lines(text), RST_RULES))


def html_title(html: Column) -> Column:
    title = T.strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    return F.nullif(title, F.lit(""))


def html_to_markdown(html: Column) -> Column:
    """Text of ``main``, else ``article``, else ``body``, with headings marked and one line per block."""
    part = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit(""))
    return T.strip(_apply(F.coalesce(part("main"), part("article"), part("body"), html), HTML_RULES))


def html_links(html: Column) -> Column:
    """Distinct link targets without fragments, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'#\s]+)"), 1), T.normal_url))


def markdown_links(text: Column) -> Column:
    """Targets of markdown links in order."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), 1)
