"""Declarations in source files: every line is matched against its language's patterns; enclosing types come from a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Suffix to language, and per language the line patterns (kind, pattern with the name as group 1).
LANGUAGES = {"py": "python", "gd": "gdscript", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "rs": "rust", "go": "go", "cpp": "cpp", "h": "cpp", "frag": "glsl", "vert": "glsl", "glsl": "glsl", "comp": "glsl", "geom": "glsl", "tesc": "glsl", "tese": "glsl", "hlsl": "hlsl", "fx": "hlsl", "usf": "hlsl", "ush": "hlsl"}
PATTERNS = {
    "python": [("class", r"^\s*class\s+(\w+)"), ("method", r"^\s*(?:async\s+)?def\s+(\w+)\s*\("), ("constant", r"^([A-Z][A-Z0-9_]+)\s*=")],
    "gdscript": [("class", r"^class_name\s+(\w+)"), ("method", r"^\s*(?:static\s+)?func\s+(\w+)\s*\("), ("constant", r"^const\s+(\w+)"), ("signal", r"^signal\s+(\w+)")],
    "typescript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)"), ("method", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*[(<]"), ("constant", r"^(?:export\s+)?const\s+([A-Z][A-Z0-9_]+)\b")],
    "rust": [("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|impl)\s+(\w+)"), ("method", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)")],
    "go": [("class", r"^type\s+(\w+)\s+(?:struct|interface)"), ("method", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("), ("constant", r"^const\s+(\w+)")],
    "cpp": [("class", r"^\s*(?:class|struct)\s+(\w+)\s*(?::|\{|$)"), ("constant", r"^\s*static\s+const\s+\w+\s+(\w+)"), ("method", r"^\s*(?:virtual\s+|static\s+|inline\s+)?(?:const\s+)?[A-Za-z_]\w*(?:::\w+)?[&*]?\s+[&*]?(\w+)\s*\([^;]*\)?\s*(?:const\s*)?\{\s*$")],
    "hlsl": [("class", r"^\s*struct\s+(\w+)"), ("constant", r"^\s*#define\s+(\w+)"), ("property", r"^\s*(?:cbuffer|tbuffer)\s+(\w+)"), ("property", r"^\s*(?:RW)?(?:Texture\w*|Buffer|StructuredBuffer|ByteAddressBuffer|SamplerState)\s*(?:<[^>]*>)?\s+(\w+)"), ("method", r"^\s*(?:static\s+|inline\s+)*(?:void|bool|int|uint|half|float|double)(?:[1-4](?:x[1-4])?)?\s+(\w+)\s*\([^;]*$")],
    "glsl": [("class", r"^\s*struct\s+(\w+)"), ("constant", r"^\s*#define\s+(\w+)"), ("property", r"^\s*(?:layout\s*\([^)]*\)\s*)?(?:uniform|in|out|varying|attribute|buffer)\s+\w+\s+(\w+)\s*(?:\[[^\]]*\])?\s*;"), ("property", r"^\s*(?:layout\s*\([^)]*\)\s*)?(?:uniform|buffer)\s+(\w+)\s*\{?\s*$"), ("method", r"^\s*(?:void|float|int|bool|u?vec[234]|mat[234])\s+(\w+)\s*\([^;]*\)\s*\{\s*$")],
}


def language_of(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[T.path_suffix(path)]


def _may_declare(language: Column, line: Column) -> Column:
    """Whether a line matches any pattern of its language: one pattern for each line, before kind and name are looked for."""
    patterns = {lang: "|".join(f"(?:{pattern})" for _, pattern in patterns) for lang, patterns in PATTERNS.items()}
    hit = F.lit(False)
    for lang, pattern in patterns.items():
        hit = F.when(language == lang, line.rlike(pattern)).otherwise(hit)
    return hit


def _declared(language: Column, line: Column) -> tuple[Column, Column]:
    """Kind and name of the declaration in a line; null where there is none."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, patterns in PATTERNS.items():
        for label, pattern in reversed(patterns):
            hit = (language == lang) & line.rlike(pattern)
            kind = F.when(hit, label).otherwise(kind)
            name = F.when(hit, F.regexp_extract(line, pattern, 1)).otherwise(name)
    return kind, name


def declarations(documents: DataFrame, content: str = "raw_content") -> DataFrame:
    """``doc_id``, ``line_no`` (from 0), ``language``, ``kind``, ``name`` and ``signature`` of every declaration line; a narrow plan."""
    files = documents.where(~T.is_url(F.col("path"))).select("doc_id", language_of(F.col("path")).alias("language"), T.uniform_lines(F.col(content)).alias("code")).where(F.col("language").isNotNull())
    lines = files.select("doc_id", "language", F.posexplode(F.split("code", "\n")).alias("line_no", "line"))
    kind, name = _declared(F.col("language"), F.col("line"))
    found = lines.select("doc_id", "line_no", "language", kind.alias("kind"), name.alias("name"), "line")
    return found.where(F.col("kind").isNotNull()).select("doc_id", "line_no", "language", "kind", "name", T.strip(F.regexp_replace("line", r"[\s{:]+$", "")).alias("signature"))


def with_parents(found: DataFrame) -> DataFrame:
    """Adds ``parent``: the last type declared above a method in its file."""
    above = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "class", F.col("name")), ignorenulls=True).over(above)
    return found.withColumn("parent", F.when(F.col("kind") == "method", last))


# Lines that belong to the declaration right below them: comments, decorators, attributes.
_ATTACHED = {"hash": r"^\s*(?:#|@)", "slash": r"^\s*(?://|/\*|\*(?:[\s/]|$)|@|#\[)"}
# In these languages a function at the start of a line has no enclosing type.
_FREE = ("python", "rust", "typescript")


def source_chunks(documents: DataFrame, content: str = "raw_content") -> DataFrame:
    """A chunk for every declaration of a source file: its lines up to the next declaration, with the comments and decorators above it.

    ``doc_id``, ``chunk_index`` (order in the file), ``chunk_type``, ``parent_name``, ``qualified_name``, ``heading``, ``summary``, ``content``,
    ``token_count``, ``first_line``, ``last_line`` (from 0). Lines above the first declaration start no chunk. A file in which nothing is
    declared is one ``class_overview`` with its whole text, if it has one. A narrow plan: every line is tried once.
    """
    language = F.col("language")
    text = T.uniform_lines(F.col(content))
    files = documents.select("doc_id", T.path_stem(F.col("path")).alias("stem"), language_of(F.col("path")).alias("language"), F.coalesce("title", T.title_of(F.col(content), F.col("path"))).alias("title"), F.split(text, "\n").alias("lines")).where(language.isNotNull())

    def mark(line: Column, number: Column) -> Column:
        hit = _may_declare(language, line)
        above = F.when(language.isin("python", "gdscript"), line.rlike(_ATTACHED["hash"])).otherwise(line.rlike(_ATTACHED["slash"]))
        return F.struct(number.alias("no"), F.when(hit, "hit").when(above, "attached").otherwise("other").alias("is"))

    lines = files.withColumn("marks", F.transform("lines", mark)).withColumn("marks", F.filter("marks", lambda m: m["is"] != "attached"))
    began = lambda m, at: F.struct(m["no"].alias("no"), m["is"].alias("is"), F.when(at == 0, 0).otherwise(F.get("marks", at - 1)["no"] + 1).alias("first"))
    hits = lines.withColumn("found", F.filter(F.transform("marks", began), lambda m: m["is"] == "hit")).drop("marks")

    def named(m: Column) -> Column:
        line = F.get("lines", m["no"])
        kind, name = _declared(language, line)
        return F.struct(m["no"].alias("no"), kind.alias("kind"), name.alias("name"), line.rlike(r"^\S").alias("outer"), m["first"].alias("first"))

    found = hits.withColumn("found", F.transform("found", named))
    types = found.withColumn("types", F.filter("found", lambda m: m["kind"] == "class"))

    def chunk(m: Column, at: Column) -> Column:
        end = F.coalesce(F.get("found", at + 1)["first"], F.size("lines"))
        free = language.isin(*_FREE) & m["outer"]
        last = F.try_element_at(F.filter("types", lambda t: t["no"] < m["no"]), F.lit(-1))["name"]
        parent = F.when((m["kind"] == "method") & ~free, last)
        text = F.array_join(F.slice("lines", m["first"] + 1, end - m["first"]), "\n")
        return F.struct(m["kind"].alias("kind"), m["name"].alias("name"), parent.alias("parent"), m["no"].alias("no"), F.get("lines", m["no"]).alias("line"), m["first"].alias("first_line"), (end - 1).alias("last_line"), F.regexp_replace(text, r"\s+$", "").alias("content"))

    def whole() -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit("whole").alias("kind"), F.col("title").alias("name"), none.alias("parent"), F.lit(0).alias("no"), none.alias("line"), F.lit(0).alias("first_line"), (F.size("lines") - 1).alias("last_line"), F.array_join("lines", "\n").alias("content"))

    chunks = F.when(F.size("found") == 0, F.array(whole())).otherwise(F.transform("found", chunk))
    # The outer generator keeps the optimizer from computing the chunks once more for a filter on their number.
    flat = types.select("doc_id", "stem", "language", F.posexplode_outer(chunks).alias("chunk_index", "c")).where(T.strip(F.col("c.content")) != "")
    is_whole = F.col("c.kind") == "whole"
    return flat.select(
        "doc_id",
        "chunk_index",
        F.when(F.col("c.kind").isin("class", "whole"), "class_overview").when((language == "glsl") & (F.col("c.name") == "main"), "shader_entry_point").otherwise(F.col("c.kind")).alias("chunk_type"),
        F.when(is_whole, F.col("c.name")).otherwise(F.concat_ws(".", "stem", "c.parent")).alias("parent_name"),
        F.when(is_whole, F.col("c.name")).otherwise(F.concat_ws(".", "stem", "c.parent", "c.name")).alias("qualified_name"),
        F.col("c.name").alias("heading"),
        F.when(is_whole, T.first_sentence(F.col("c.content"))).otherwise(T.strip(F.regexp_replace("c.line", r"[\s{:]+$", ""))).alias("summary"),
        F.col("c.content").alias("content"),
        T.token_estimate(F.col("c.content")).alias("token_count"),
        F.col("c.first_line").alias("first_line"),
        F.col("c.last_line").alias("last_line"),
    )


def symbol_agreement(documents: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per chunk type of the stored symbols: how many distinct (file, name) pairs a declaration line confirms."""
    stored = symbols.where(F.col("name").isNotNull()).select("doc_id", "name", "chunk_type").distinct()
    seen = declarations(documents).select("doc_id", "name").distinct().withColumn("seen", F.lit(1))
    return stored.join(seen, ["doc_id", "name"], "left").groupBy("chunk_type").agg(F.count("*").alias("n_symbols"), F.count("seen").alias("n_declared"))
