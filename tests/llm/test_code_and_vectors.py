"""Foreign source files, function documentation and nearest vectors on small fixtures, with dirty rows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import function_text, p3_neighbours, p4_sources, p5_functions, source_text

T0 = datetime.datetime(2024, 1, 1)


# problem 3


def test_notices_below_long_headers_and_in_long_comments():
    code = "def scale(value):\n    return value * 3\n"
    header = "\n".join(f"# Remark {i} about the layout of this module." for i in range(30))
    foreign = "# This code was copied from the Zephyrine library."
    assert "vendored" not in source_text.reasons("src/a.py", f"{header}\n{code}", "own")
    assert "vendored" in source_text.reasons("src/a.py", f"{header}\n{foreign}\nimport os\n\n{code}", "own")
    assert "vendored" not in source_text.reasons("src/a.py", f"{header}\n{code}\n{foreign}\n{code}", "own")
    assert source_text.reasons("src/a.py", f"# Code generated by stubgen from {'very/' * 40}long.proto. DO NOT EDIT.\n{code}", "own") == ["generated"]


def test_many_lists_are_all_compared():
    rng = np.random.default_rng(4)
    rows, centroids = rng.standard_normal((400, 8)).astype(np.float32), rng.standard_normal((20_000, 8)).astype(np.float32)
    score = rows @ centroids.T - 0.5 * (centroids**2).sum(axis=1)
    kept = np.sort(np.take_along_axis(score, p3_neighbours.nearest(rows, centroids, 6), 1), axis=1)
    assert np.allclose(kept, np.sort(score, axis=1)[:, -6:])


def test_lists_follow_the_rows():
    assert [p3_neighbours.number_of_lists(n) for n in (1, 331_064, 10_000_000, 1_000_000_000)] == [1, 646, 19_531, 65_536]


def test_lists_are_fitted_in_parts(spark, monkeypatch):
    """A coarse part that holds most rows is salted: no task fits more than TOP_SAMPLE vectors, and no list is lost."""
    rng = np.random.default_rng(6)
    vectors = np.concatenate([rng.standard_normal((1, 64)) + 0.3 * rng.standard_normal((1500, 64)), rng.standard_normal((300, 64))])
    monkeypatch.setattr(p3_neighbours, "TOP_SAMPLE", 300)
    lists, n_rows = p3_neighbours.fit_lists(p3_neighbours.prepared(chunk_table(spark, vectors)), list_size=20)
    assert n_rows == 1800 and 80 <= len(lists.centroids) <= 100 and len(lists.blocks) == len(lists.centroids)


def chunk_table(spark, vectors, extra=()):
    rows = [(f"id{i:05d}", [float(x) for x in v], T0) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], "id string, embedding array<float>, created_at timestamp").withColumn("vec", F.lit("clash")).withColumn("cell", F.lit(1))


def exact(vectors, k, least=None):
    unit = np.array(vectors, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 12)
    out = {}
    for i in range(len(unit)):
        order = [j for j in np.lexsort((np.arange(len(unit)), -cosine[i])) if j != i]
        out[i] = [j for j in order[:k] if least is None or cosine[i, j] >= least]
    return out


def test_mutual_pairs_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((600, 64))
    vectors = np.concatenate([base, base[:200] + 0.25 * rng.standard_normal((200, 64)), base[:40] * 3])
    near = exact(vectors, 10, 0.9)
    truth = {(f"id{i:05d}", f"id{j:05d}") for i in near for j in near[i] if i < j and i in near[j]}
    got = {(r["id_a"], r["id_b"]) for r in p3_neighbours.mutual_pairs(chunk_table(spark, vectors), list_size=64).collect()}
    assert len(truth) > 200 and got <= truth and len(got) >= 0.98 * len(truth)
    grid = {(r["id_a"], r["id_b"]) for r in p3_neighbours.mutual_pairs(chunk_table(spark, vectors), list_size=64, block=16).collect()}
    assert grid == got


def test_recall_of_the_ten_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 64))
    vectors = centres[rng.integers(0, 30, 1500)] + 0.8 * rng.standard_normal((1500, 64))
    truth = exact(vectors, 10)
    table = p3_neighbours.prepared(chunk_table(spark, vectors))
    got = p3_neighbours.neighbours(table, probes=12, list_size=32).collect()
    assert len(got) == 15_000 and {r["rank"] for r in got} == set(range(1, 11))
    met = sum(int(r["neighbour"][2:]) in truth[int(r["id"][2:])] for r in got)
    assert met / 15_000 >= 0.9
    report = {r["setting"]: r["recall"] for r in p3_neighbours.recall(chunk_table(spark, vectors), every=10, min_similarity=0.5).collect()}
    assert report["search"] >= 0.9 and report["pairs"] >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    one = [1.0] + [0.0] * 63
    later = T0 + datetime.timedelta(1)
    extra = [("zero", [0.0] * 64, T0), ("short", [1.0] * 63, T0), ("nan", [float("nan")] * 64, T0), ("inf", [float("inf")] * 64, T0), ("null", None, T0), (None, one, T0), ("empty", [], T0), ("part", [None] + [1.0] * 63, T0), ("id00000", [0.0, 1.0] + [0.0] * 62, later)]
    table = p3_neighbours.prepared(chunk_table(spark, [one] * 40, extra))
    got = p3_neighbours.neighbours(table, k=10).collect()
    assert {r["id"] for r in got} == {f"id{i:05d}" for i in range(40)}
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["neighbour"])
    assert sorted(by["id00035"]) == [f"id{i:05d}" for i in range(1, 11)]
    assert sorted(by["id00001"]) == [f"id{i:05d}" for i in range(2, 12)]
    pairs = {(r["id_a"], r["id_b"]) for r in p3_neighbours.mutual_pairs(chunk_table(spark, [one] * 40, extra)).collect()}
    assert pairs == {(f"id{i:05d}", f"id{j:05d}") for i in range(1, 12) for j in range(i + 1, 12)}
    assert p3_neighbours.mutual_pairs(chunk_table(spark, [one]).limit(0)).count() == 0


def test_abandoning_loses_little():
    rng = np.random.default_rng(4)
    q = rng.standard_normal((300, 64))
    m = np.concatenate([q + 0.3 * rng.standard_normal((300, 64)), rng.standard_normal((2000, 64))])
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    q, m = (x / np.linalg.norm(x, axis=1, keepdims=True) @ turn for x in (q, m))
    r, c, s = p3_neighbours.adaptive_scan(q, m, 10, 0.9)
    truth = {(int(i), int(j)) for i, j in zip(*np.nonzero(q @ m.T >= 0.9))}
    assert set(zip(r.tolist(), c.tolist())) <= truth and len(r) >= 0.99 * len(truth)
    assert np.allclose(s, np.einsum("ij,ij->i", q[r], m[c]))


# problem 4


HAND = "import queue\n\nclass Reader:\n    def take_many(self, amount):\n        # keep the order of arrival\n        for item in self.items:\n            self.handle_item(item)\n        return amount\n"
VERBS = "open read sort merge split fold trim scan pack seal lift move join drop hold keep send wrap sink turn".split()
LIBRARY = "\n".join(f"def {v}_{w}s(value):\n    return {w}_{v}(value, {w}) + offset_of_{v}" for v, w in zip(VERBS, reversed(VERBS)))
CASES = [
    ("src/a.py", HAND, "lib-core", []),
    ("src/b.py", "# Code generated by maker. DO NOT EDIT.\n" + HAND, "lib-core", ["generated"]),
    ("src/c.py", "# The template below puts DO NOT EDIT at the top of every produced file.\n" + HAND, "lib-core", []),
    ("src/d.py", "# This module writes generated bindings; the writer itself is kept by hand.\n" + HAND, "lib-core", []),
    ("src/e.go", "// Fichier produit par outil ; ne pas modifier.\n" + HAND, "lib-core", ["generated"]),
    ("src/e2.py", "# AUTOGENERATED -- edit script.tmpl and run maker again\n" + HAND, "lib-core", ["generated"]),
    ("src/f_pb2.py", HAND, "lib-core", ["generated"]),
    ("gen/g.rs", "\n".join(f"pub fn get_{i:03d}(m: &Msg) -> u32 {{ m.slot({i}, {i * 8}) }}" for i in range(40)), "lib-core", ["generated"]),
    ("web/h.js", "!function(e,t,n){" + "".join(f"var {c}=e(t,{i});for(let o=0;o<n.length;o++)t[o]^=n[o];" for i, c in enumerate("abcdefghij" * 6)) + "}();", "lib-core", ["minified"]),
    ("web/argmin.js", HAND + 'PATTERN = "' + "|".join(f"word_{i}" for i in range(90)) + '"', "lib-core", []),
    ("res/i.py", "LUT = [" + ", ".join(str(i * 37 % 1000) for i in range(300)) + "]", "lib-core", ["data"]),
    ("res/j.gd", "id,name,x,y\n" + "\n".join(f"{i},item_{i},0.{i},1.{i}" for i in range(30)), "lib-core", ["data"]),
    ("res/k.cpp", "\n".join(f"2024-01-{i % 28 + 1:02d} 10:00 INFO step took {i}ms" for i in range(30)), "lib-core", ["data"]),
    ("third_party/zip/zip.py", HAND, "lib-core", ["vendored"]),
    ("shop/vendor/x1/vendor_list.py", HAND, "lib-core", []),
    ("vendor/fastzip/fastzip_core.py", HAND, "lib-core", ["vendored"]),
    ("src/l.py", "# Part of the Fastzip project; see the licence file for terms.\n" + HAND, "lib-core", ["vendored"]),
    ("src/m.py", "# Part of the Lib project; see the licence file for terms.\n" + HAND, "lib-core", []),
    ("src/n.py", "# Replaces the vendored copy we used before; rewritten from scratch.\n" + HAND, "lib-core", []),
    ("src/o.py", "# fastzip 1.2.3 - upstream copy, local changes: none.\n" + HAND, "lib-core", ["vendored"]),
    ("src/p.py", "", "lib-core", []),
    ("src/q.py", None, None, []),
]


@pytest.mark.parametrize(("path", "text", "source", "expected"), CASES, ids=[c[0] for c in CASES])
def test_reasons(path, text, source, expected):
    assert source_text.reasons(path, text, source) == expected


def test_foreign_files(spark):
    edited = LIBRARY.replace("def sort_wraps(", "def renamed_step(").replace("\n    return", "\n        return") + "\n# local patch\n"
    rows = [(i, p, t, s) for i, (p, t, s, _) in enumerate(CASES)] + [(100, "src/copy.py", edited, "lib-core"), (101, "src/part.py", HAND + LIBRARY[:400], "lib-core"), (102, "https://x.example/a.py", LIBRARY, "s"), (103, None, LIBRARY, "s"), (104, "notes.md", LIBRARY, "s"), (100, "src/copy.py", edited, "lib-core")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, raw_content string, source string").withColumn("line", F.lit(1)).withColumn("file_id", F.lit(2)).withColumn("reason", F.lit("x"))
    upstream = spark.createDataFrame([(1, "fastzip", LIBRARY), (5, None, None)], "file_id long, package string, content string")
    got = {r["doc_id"] for r in p4_sources.found(docs, upstream).collect()}
    assert got == {i for i, c in enumerate(CASES) if c[3]} | {100}
    copies = p4_sources.upstream_copies(docs, upstream).collect()
    assert {(r["doc_id"], r["file_id"]) for r in copies} == {(100, 1)} and all(r["containment"] > 0.8 for r in copies)
    assert p4_sources.found(docs.limit(0), upstream).count() == 0
    assert p4_sources.found(docs, upstream.limit(0)).count() == len(got) - 1
    kept = p4_sources.handwritten_report(docs.dropDuplicates(["doc_id"]), upstream).where("source = 'lib-core'").first()
    assert kept["n_files"] - kept["n_handwritten"] == len(got)


def test_files_of_many_packages_and_of_short_lines(spark):
    """A library that five packages ship, with other lines around it, is found for all of them; so is one of short lines only."""
    short = "\n".join(f"{a}{b}=1" for a in "abcdef" for b in "xyz")
    upstream = spark.createDataFrame([(i, f"package{i}", LIBRARY + f"\npackage_{i} = {i}") for i in range(5)] + [(7, "short", short)], "file_id long, package string, content string")
    docs = spark.createDataFrame([(1, "src/a.py", LIBRARY, "s"), (2, "src/b.py", short.replace("ax=1", "ax=2"), "s"), (3, "src/c.py", "ax=1\nay=1\n" + HAND, "s")], "doc_id long, path string, raw_content string, source string")
    got = {(r["doc_id"], r["file_id"]) for r in p4_sources.upstream_copies(docs, upstream).collect()}
    assert got == {(1, i) for i in range(5)} | {(2, 7)}


def test_copies_across_repositories(spark):
    """A file that another source marks as third-party leads to its unmarked, edited copies; a mark of the own source does not."""
    edited = LIBRARY.replace("def sort_wraps(", "def renamed_step(")
    docs = spark.createDataFrame(
        [(1, "third_party/zip/zip.py", LIBRARY, "a"), (2, "third_party/zip/zip.py", LIBRARY, "c"), (3, "src/own.py", edited + HAND, "b"), (4, "src/twin.py", edited, "a"), (5, "third_party/x/x.py", HAND, "d"), (6, "src/x.py", HAND, "d"), (7, "src/y.py", HAND, None)],
        "doc_id long, path string, raw_content string, source string",
    )
    copies = p4_sources.repository_copies(docs, p4_sources.judged_files(docs)).collect()
    assert {(r["doc_id"], r["n_sources"]) for r in copies} == {(1, 2), (2, 2), (3, 2), (3, 1), (4, 2), (7, 1)}
    assert {r["doc_id"] for r in p4_sources.found(docs, spark.createDataFrame([], "file_id long, package string, content string")).collect()} == {1, 2, 3, 4, 5, 7}


# problem 5


FUNCTIONS = [
    ("load_map", "```python\ndef load_map(self, path: str) -> int:\n    \"\"\"Reads tiles from disk and caches each region before drawing.\"\"\"\n    return 1\n```", None, True),
    ("load_map", "```python\ndef load_map(self, path: str) -> int:\n    # reads tiles from disk and caches each region\n    return 1\n```", "", False),
    ("load_map", "```python\ndef load_map(path):\n```", "Load map.", False),
    ("loadMap", "```cpp\n/// This method will load map.\nint loadMap(int a)\n```", "int loadMap(int a)", False),
    ("loadMap", "```cpp\n/** Loads map. @param a limit for the tile */\nint loadMap(int a) {\n}\n```", None, False),
    ("loadMap", "```cpp\nint loadMap(int a)\n```\n\nBlocks until every tile has arrived from the server.", None, True),
    ("LoadMap", "```go\n// TODO: document\nfunc (s *Atlas) LoadMap(a int) int {\n}\n```", "TODO: document", False),
    ("loadMap", "```typescript\nloadMap(a: number): string\n```\n\n@param a limit for the tile\n@returns string", None, False),
    ("loadMap", "```typescript\nloadMap(a: number): string\n```\n\nx = loadMap(1)", "See base class.", False),
    ("load_map", "```gdscript\n## Old version below\n## return load_map(1)\nfunc load_map() -> int:\n```", None, False),
    ("load_map", "```rust\npub fn load_map(a: &str) -> u32\n```", "每个网格每次最多清空二百个值。", True),
    ("load_map", "```rust\n/// 待补充\npub fn load_map(a: &str) -> u32\n```", "", False),
    ("load_map", "```rust\npub fn load_map(a: &str) -> u32\n```", "Schlägt der Aufruf fehl, bleibt die Karte geprüft.", True),
    ("load_map", "", None, False),
    (None, None, None, False),
    ("load_map", "```rust\n/// {@inheritDoc}\npub fn load_map(a: &str) -> u32 {\n    let a = 1;\n}\n```", "(c) the authors", False),
]


@pytest.mark.parametrize(("name", "content", "summary", "expected"), FUNCTIONS)
def test_documentation(name, content, summary, expected):
    assert function_text.read_function(name, content, summary).says_something is expected


@pytest.mark.parametrize(
    ("signature", "expected"),
    [("def f(self, a: int, b: str = 'x') -> int", "int,str"), ("int f(const Node& a, size_t b)", "Node&,size_t"), ("func (s *T) F(a int, b []byte) int", "int,[]byte"), ("f(a: Map<string, number>): void", "Map<string,number>"), ("void main()", ""), ("pub fn f(&self, a: Vec<u8>) -> u32", "Vec<u8>")],
)
def test_overloads(signature, expected):
    assert function_text.overload_of(signature) == expected


def test_pairs_join_declarations_with_definitions(spark):
    doc = "Blocks until every tile has arrived from the server."
    chunks = spark.createDataFrame(
        [
            ("c1", "d1", "method", "map_h.Atlas.load", f"```cpp\n/// {doc}\nint load(int a, float b);\n```", "", T0),
            ("c2", "d2", "method", "map_cpp.Atlas.load", "```cpp\nint load(int x, float y) {\n    return x;\n}\n```", "int load(int x, float y)", T0),
            ("c3", "d2", "method", "map_cpp.Atlas.load", "```cpp\nint load(int x) {\n    return x;\n}\n```", None, T0),
            ("c1", "d1", "method", "map_h.Atlas.load", f"```cpp\n/// {doc}\nint load(int a, float b);\n```", "", T0 + datetime.timedelta(1)),
            ("c4", "d9", "constant", "x.Y", doc, doc, T0),
            (None, "d9", "method", "x.Y", doc, doc, T0),
            ("c5", None, "method", None, None, None, None),
        ],
        "id string, document_id string, chunk_type string, qualified_name string, content string, summary string, created_at timestamp",
    ).withColumn("scope", F.lit("clash"))
    symbols = spark.createDataFrame([(7, 2, "go", "shader_entry_point", f"```glsl\nvoid go() {{\n}}\n```\n\n{doc}", None, None), (7, 2, "go", "shader_entry_point", f"```glsl\nvoid go() {{\n}}\n```\n\n{doc}", None, None)], "symbol_id long, doc_id long, name string, chunk_type string, content string, summary string, parent string")
    docs = spark.createDataFrame([(1, "d1", "lib"), (2, "d2", "lib"), (3, "d2", "lib")], "doc_id long, id string, source string").withColumn("owner", F.lit("clash")).withColumn("path", F.lit("src/x.cpp"))
    pairs = {r["row_key"]: r for r in p5_functions.function_pairs(chunks, symbols, docs).collect()}
    assert {k: r["doc_from"] for k, r in pairs.items()} == {"c1": "own", "c2": "declaration", "7": "own"}
    assert pairs["c2"]["documentation"] == doc and "return x;" in pairs["c2"]["code"]
    assert {(r["table_name"], r["row_key"]) for r in p5_functions.found(chunks, symbols).collect()} == {("chunks", "c1"), ("symbols", "7")}
    assert p5_functions.found(chunks.limit(0), symbols.limit(0)).count() == 0


def test_definitions_take_their_own_class_documentation(spark):
    """Classes of one name in two modules keep their documentation apart, and ambiguous declarations give none."""
    doc = lambda what: f"/// Blocks until every {what} has arrived from the distant server."
    declared = lambda what: f"```cpp\n{doc(what)}\nint load(int a);\n```"
    defined = "```cpp\nint load(int a) {\n    return a + 1;\n}\n```"
    rows = [
        ("a1", "da", "one.Map.load", declared("tile")), ("a2", "da", "one.Map.load", defined), ("b1", "db", "two.Map.load", declared("river")), ("b2", "db", "two.Map.load", defined),
        ("c1", "da", "api.Sky.load", declared("cloud")), ("c2", "db", "impl.Sky.load", defined), ("d1", "da", "x.Sea.load", declared("ship")), ("d2", "da", "x.Sea.load", declared("boat")), ("d3", "da", "x.Sea.load", defined),
        ("e2", "db", "three.Map.load", defined),
    ]
    chunks = spark.createDataFrame([(i, d, "method", q, c, None, T0) for i, d, q, c in rows], "id string, document_id string, chunk_type string, qualified_name string, content string, summary string, created_at timestamp")
    symbols = spark.createDataFrame([], "symbol_id long, doc_id long, name string, chunk_type string, content string, summary string, parent string")
    docs = spark.createDataFrame([(1, "da", "s", "one.h"), (2, "db", "s", "two.h")], "doc_id long, id string, source string, path string")
    pairs = {r["row_key"]: r["documentation"] for r in p5_functions.function_pairs(chunks, symbols, docs).where("doc_from = 'declaration'").collect()}
    assert set(pairs) == {"a2", "b2", "c2"} and "tile" in pairs["a2"] and "river" in pairs["b2"] and "cloud" in pairs["c2"]


def test_documentation_is_judged_after_declarations_are_joined(spark):
    """What restates the signature of a function's declaration, or of its definition, says nothing, though its own signature has other names."""
    restated, says = "Loads tile, river and castle.", "Blocks until every ship has arrived from the distant server."
    row = lambda signature, doc, body: f"```cpp\n/// {doc}\n{signature}" + (" {\n    return a + 1;\n}\n```" if body else ";\n```")
    named, other, bare = "int load(int tile, float river, bool castle)", "int load(int ship, float river, bool castle)", "int load(int a, float b, bool c)"
    rows = [
        ("a1", "dh", "one.Map.load", row(named, says, False)), ("a2", "dc", "one.Map.load", row(bare, restated, True)),  # the definition restates its declaration
        ("b1", "dh", "two.Sea.load", row(bare, restated, False)), ("b2", "dc", "two.Sea.load", row(named, says, True)),  # the other way round
        ("c1", "dh", "api.Sky.load", row(named, says, False)), ("c2", "dc", "impl.Sky.load", row(bare, restated, True)),  # by type and name
        ("d1", "dc", "lone.Bay.load", row(bare, restated, True)), ("d2", "dx", "one.Map.load", row(bare, restated, True)),  # no declaration; one in another source
        ("e1", "dh", "x.Fog.load", row(named, says, False)), ("e2", "dh", "x.Fog.load", row(other, says, False)), ("e3", "dc", "x.Fog.load", row(bare, restated, True)),  # ambiguous
        ("f1", "dh", "y.Ice.load", row(named, says, False)), ("f2", "dc", "y.Ice.load", row(bare, says, True)),
        ("h1", "dh", "api.Oak.load", row(named, says, False)), ("h2", "dc", "p.Oak.load", row(bare, restated, True)), ("h3", "dc", "q.Oak.load", row(bare, restated, True)),  # two modules define it
    ]
    chunks = spark.createDataFrame([(i, d, "method", q, c, None, T0) for i, d, q, c in rows], "id string, document_id string, chunk_type string, qualified_name string, content string, summary string, created_at timestamp")
    symbols = spark.createDataFrame(
        [(1, 1, "load", "method", row(named, says, False), None, "Elm"), (2, 2, "load", "method", row(bare, restated, True), says, "Elm"), (3, 2, "load", "method", row(bare, restated, True), restated, "Elm"), (4, 2, None, "method", row(bare, restated, True), None, None)],
        "symbol_id long, doc_id long, name string, chunk_type string, content string, summary string, parent string",
    )
    docs = spark.createDataFrame([(1, "dh", "s", "m.h"), (2, "dc", "s", "m.cpp"), (3, "dx", "t", "m.cpp")], "doc_id long, id string, source string, path string")
    dropped = {"a2", "b1", "c2", "3"}
    keys = {r[0] for r in rows} | {"1", "2", "3", "4"}
    assert {r["row_key"] for r in p5_functions.found(chunks, symbols, docs).collect()} == keys - dropped
    pairs = {r["row_key"]: (r["doc_from"], r["documentation"]) for r in p5_functions.function_pairs(chunks, symbols, docs).collect()}
    assert pairs["a2"] == pairs["c2"] == pairs["3"] == ("declaration", says) and pairs["2"] == ("own", says) and "b1" not in pairs
    assert {k for k, (origin, _) in pairs.items() if origin == "own"} == keys - dropped
