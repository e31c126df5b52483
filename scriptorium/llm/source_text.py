"""Token-composition and marker rules for one source file."""

from __future__ import annotations

import re

# Suffixes of source files; folders that hold third-party code; folder and file names of generated code.
SUFFIXES = ("py", "gd", "ts", "tsx", "js", "jsx", "rs", "go", "cpp", "h", "frag", "vert", "glsl")
VENDORED = {"node_modules", "bower_components", "third_party", "thirdparty", "third-party", "3rdparty", "3rd_party", "site-packages", "jspm_packages", "pods"}
VENDORED_MAYBE = {"vendor", "vendors", "vendored", "external", "externals", "extern", "deps", "dependencies", "contrib", "libs", "carthage"}
GENERATED_NAME = re.compile(r"(?i)(?:\.(?:pb|g|gen|generated|designer)\.[a-z]+$|_(?:generated|pb2|pb2_grpc|gen)\.[a-z]+$|\.(?:pb|g|gen)\.[a-z]+$)")
MINIFIED_NAME = re.compile(r"(?i)[.-](?:min|prod|bundle|chunk|umd|iife)\.(?:js|jsx|ts|tsx)$")

GENERATOR = re.compile(
    r"""(?ix)(?:
      @generated\b | <auto-?generated> | \bauto-?generated\b.{0,12}\bedit\b.{0,60}\b(?:again|tmpl|template) | \bregenerate\ with\b
    | \b(?:code\ |file\ |this\ file\ (?:is|was)\ )?(?:auto-?generated|automatically\ generated|machine[- ]generated|generated)\ (?:by|from|with|using)\b
    | \b(?:machine|compiler|tool)\ output\ of\b | \boutput\ of\ \w+\ \d | \bproduced\ (?:by|from)\ \w+
    | \bautogenerado\ (?:por|con)\b | \bgenerado\ autom[aá]ticamente | \bautomatisch\ (?:erzeugt|generiert)\ (?:von|durch|aus|mit)\b | \b(?:erzeugt|generiert)\ von\b
    | \bfichier\ (?:produit|g[ée]n[ée]r[ée])\ par\b | \bg[ée]n[ée]r[ée]\ automatiquement | 自动生成 | 由\s*\S+\s*生成 | 請勿編輯|请勿(?:编辑|修改|手动)
    )"""
)
NO_EDIT = re.compile(r"(?i)\bdo not (?:edit|modify|change)\b|\bno editar\b|\bnicht (?:von hand )?(?:ändern|bearbeiten)\b|\bne pas (?:modifier|éditer)\b|请勿")
ABOUT = re.compile(r"(?i)\b(?:the template|templates|this module|this script|the script|the writer|we|writes?|puts?|never commit|rewritten|by hand|below|emits)\b")
UPSTREAM_MARK = re.compile(
    r"(?i)\bupstream copy\b|\bimported verbatim\b|\bcopied from (?:the )?\S+ (?:distribution|project|library|repository|package)\b|\ba small library by\b|\bsingle[- ](?:file|header) edition\b|\bvendored (?:from|copy of)\b|\btaken from (?:the )?\S+ (?:distribution|project|library)\b|\bthird[- ]party (?:code|library|component)\b"
)
NOT_UPSTREAM = re.compile(r"(?i)\b(?:replaces?|instead of|rewritten|unlike|used before|not a)\b")
NOTICE = re.compile(r"(?i)(?:copyright \(c\) (?:\d{4}(?:[-–]\d{4})? )?(?:by )?(?:the )?([\w.-]+)|part of the ([\w.-]+) project|this file belongs to ([\w.-]+?)\.(?:\s|$))")
COMMENT_LINE = re.compile(r"^\s*(?://+|#+|/\*+!?|\*+|--|;|<!--|\"\"\"|''')\s?(.*)$")
DECLARATION = re.compile(r"^\s*(?:(?:export|default|pub(?:\([^)]*\))?|async|static|abstract|unsafe|inline|virtual)\s+)*(?:(?:def|class|class_name|func|fn|function|struct|enum|impl|trait|interface|type)\b|[A-Za-z_][\w:<>*&\s]*\([^;]*\)\s*(?:const\s*)?\{?\s*$)")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)[fFuUlL]*\b")
RECORD = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\d\d:\d\d:\d\d|\[?\d{10,13}\]?\s|[^,;\t]*(?:\t[^,;\t]*){3,}$)")
DIGITS = re.compile(r"\d+")


def is_source_path(path: str | None) -> bool:
    return bool(path) and not re.match(r"(?i)https?://", path) and path.rpartition(".")[2].lower() in SUFFIXES


def head_comments(text: str, lines: int = 15) -> list[str]:
    """Comment texts above the first function or type, however long the header is, and among the first lines in any case."""
    out, block = [], False
    for number, line in enumerate(text.lstrip("﻿").split("\n")):
        m = COMMENT_LINE.match(line)
        if number >= lines and not block and not m and DECLARATION.match(line):
            break
        if block or m and not re.match(r"\s*#(?:include|define|version|if|pragma)", line):
            out.append((m[1] if m else line).strip().removesuffix("*/").strip())
            if re.match(r"\s*/\*", line):
                block = True
            if "*/" in line:
                block = False
    return out


def comments_of(text: str) -> list[str]:
    """Texts of all comment lines."""
    return [m[1].strip().removesuffix("*/").strip() for line in text.split("\n") if (m := COMMENT_LINE.match(line)) and not re.match(r"\s*#(?:include|define|version|if|pragma)", line)]


def marked_generated(comments: list[str]) -> bool:
    """A comment says that a tool made the file; comments about generating other files don't."""
    for comment in comments:
        if GENERATOR.search(comment) and not (ABOUT.search(comment) and not NO_EDIT.search(comment)):
            if not re.fullmatch(r"(?i)\W*auto-?generated (?:method |function )?stub\W*", comment):
                return True
    return False


def foreign_notice(comments: list[str], own: str) -> bool:
    """A head comment carries another project's notice, or says that the file was taken from upstream."""
    for comment in comments:
        if NOT_UPSTREAM.search(comment):
            continue
        if UPSTREAM_MARK.search(comment):
            return True
        m = NOTICE.search(comment)
        if m and own:
            name = next(g for g in m.groups() if g).lower().strip(".")
            if name not in own and own.split("-")[0] not in name and name not in ("the", "authors"):
                return True
    return False


def vendored_place(path: str) -> bool:
    parts = path.replace("\\", "/").split("/")
    stem = parts[-1].split(".")[0].lower()
    for i, part in enumerate(parts[:-1]):
        name = part.lower()
        if name in VENDORED:
            return True
        if name in VENDORED_MAYBE and i + 1 < len(parts) - 1:
            package = re.sub(r"[-_@]?v?\d+(?:\.\d+)*$", "", parts[i + 1].lower())
            if len(package) > 2 and stem.startswith(package):
                return True
    return False


def composition(text: str) -> dict[str, float]:
    """Token shares of a text; strings and comments don't count as identifiers."""
    bare = STRING.sub(' "" ', text)
    code = re.sub(r"//[^\n]*|/\*.*?\*/|(?m:^\s*#(?!include|define|version)[^\n]*)", " ", bare, flags=re.S)
    identifiers = IDENTIFIER.findall(code)
    numbers = len(NUMBER.findall(code))
    strings = code.count('""')
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    code_lines = [line for line in lines if not COMMENT_LINE.match(line) and len(line) > 3]
    shapes = {DIGITS.sub("0", line) for line in code_lines}
    words = [w for w in identifiers if not w.isupper() or len(w) == 1]
    return {
        "single": sum(len(w) <= 2 for w in words) / max(1, len(words)),
        "identifiers": len(identifiers),
        "literals": (numbers + strings) / max(1, numbers + strings + len(words)),
        "n_literals": numbers + strings,
        "length": len(code.strip()) / max(1, len([x for x in code.split("\n") if x.strip()])),
        "spaces": (code.count(" ") + code.count("\n") + code.count("\t")) / max(1, len(code)),
        "string_share": sum(len(s) for s in STRING.findall(text)) / max(1, len(text)),
        "shapes": len(shapes) / max(1, len(code_lines)),
        "lines": len(code_lines),
        "csv": _csv_share(code_lines),
        "records": sum(bool(RECORD.match(line)) for line in code_lines) / max(1, len(code_lines)),
    }


def _csv_share(lines: list[str]) -> float:
    """Share of lines with the same number of commas as most, without code signs."""
    rows = [line.count(",") for line in lines if line.count(",") >= 2 and not re.search(r"[(){}\[\];=]", line)]
    return max((rows.count(n) for n in set(rows)), default=0) / max(1, len(lines))


def reasons(path: str, text: str | None, source: str | None) -> list[str]:
    """Why a source file counts as not written by hand for its project: generated, minified, data, vendored."""
    text = text or ""
    out = []
    name = path.rpartition("/")[2]
    comments = head_comments(text)
    c = composition(text)
    if marked_generated(comments_of(text)) or GENERATED_NAME.search(name) or c["lines"] >= 15 and c["shapes"] < 0.3 and c["literals"] < 0.85 and max(c["csv"], c["records"]) < 0.5:
        out.append("generated")
    if c["identifiers"] >= 40 and c["single"] > 0.5 and c["spaces"] < 0.14 or MINIFIED_NAME.search(name) and (c["length"] > 120 or c["spaces"] < 0.14):
        out.append("minified")
    if c["n_literals"] >= 15 and c["literals"] > 0.8 or max(c["csv"], c["records"]) > 0.7 and c["lines"] >= 5 or c["string_share"] > 0.85 and c["lines"] >= 5:
        out.append("data")
    if vendored_place(path) or foreign_notice(comments, (source or "").strip().lower()):
        out.append("vendored")
    return out
