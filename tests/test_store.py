import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import crawl, export, search, store
from scriptorium.plans import pipeline
from scriptorium.sources import files

T0 = datetime.datetime(2024, 1, 1)


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([("s", "a", "h1", "keep"), ("s", "b", "h2", "keep"), ("s", None, "h3", "keep")], "source_id string, path string, content_hash string, extra string")
    new = spark.createDataFrame([("s", "a", "h9"), ("s", "b", "h2"), ("s", "c", "h4"), ("s", None, None)], "source_id string, path string, content_hash string")
    changes = {r["path"]: r["change"] for r in store.detect_changes(old, new).collect()}
    assert changes == {"a": "changed", "b": "same", "c": "new", None: "changed"}
    merged = {r["path"]: (r["content_hash"], r["extra"]) for r in store.upsert(old, new, ["source_id", "path"], ["content_hash"]).collect()}
    assert merged == {"a": ("h9", "keep"), "b": ("h2", "keep"), "c": ("h4", None), None: (None, "keep")}
    assert store.upsert(old.limit(0), new, ["source_id", "path"], ["content_hash"]).count() == 4
    assert store.upsert(old, new.limit(0), ["source_id", "path"], ["content_hash"]).count() == 3


def test_latest_row_wins_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", T0, 1), ("a", T0 + datetime.timedelta(1), 2), ("b", None, 3), ("b", T0, 4), (None, T0, 5)], "id string, created_at timestamp, v int")
    assert {r["id"]: r["v"] for r in store.dedupe_ids(rows).collect()} == {"a": 2, "b": 4}


def test_a_lost_job_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    tables = store.Snapshots(spark, str(tmp_path))
    tables.write("t", spark.range(3))
    with monkeypatch.context() as m:  # the job ends after the rows, before the mark
        m.setattr(store.Snapshots, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            tables.write("t", spark.range(9))
    assert tables.current("t") == 1 and tables.read("t").count() == 3
    (tmp_path / "t" / "v2" / "part-left-by-a-lost-job.parquet.crc").write_text("x")
    assert tables.write("t", spark.range(5)) == 2 and tables.read("t").count() == 5


def test_snapshots_count_once_they_are_marked(spark, tmp_path):
    snapshots = store.Snapshots(spark, str(tmp_path / "kb"))
    assert snapshots.read("t") is None
    snapshots.write("t", spark.range(3))
    snapshots.write("t", snapshots.read("t").unionByName(spark.range(2)))
    assert snapshots.current("t") == 2 and snapshots.read("t").count() == 5


def test_ingest_again_changes_only_what_changed(spark, tmp_path):
    source = tmp_path / "src" / "docs"
    source.mkdir(parents=True)
    (source / "a.md").write_text("# Alpha\n" + "alpha text " * 10)
    (source / "b.rst").write_text("Beta\n====\n\n.. note:: careful\n\n``code`` and :ref:`Title <x>` " + "beta " * 20)
    (source / "short.md").write_text("tiny")
    (source / "bad.md").write_bytes(b"\xff\xfe" + b"x" * 100)
    (tmp_path / "src" / "build").mkdir()
    (tmp_path / "src" / "build" / "c.md").write_text("# Built\n" + "built text " * 10)
    store_path = str(tmp_path / "store")
    scan = lambda: files.scan_prose(spark, str(tmp_path / "src"))
    rows = {r["path"]: r for r in scan().collect()}
    assert set(rows) == {"docs/a.md", "docs/b.rst"}
    assert rows["docs/b.rst"]["title"] == "Beta" and "**note:** careful" in rows["docs/b.rst"]["raw_content"] and "`code` and Title" in rows["docs/b.rst"]["raw_content"]
    first = pipeline.run_ingest(spark, store_path, scan(), "lib", "1")
    assert first["changed"] == 2 and first["chunks"] >= 2
    assert pipeline.run_ingest(spark, store_path, scan(), "lib", "1")["changed"] == 0
    (source / "a.md").write_text("# Alpha\n" + "changed words " * 10)
    again = pipeline.run_ingest(spark, store_path, scan(), "lib", "1")
    assert again["changed"] == 1 and again["chunks"] == first["chunks"]
    hit = pipeline.run_search(spark, store_path, "changed words").collect()
    assert len(hit) == 1 and hit[0]["parent_name"] == "Alpha"
    pipeline.run_export(spark, store_path, str(tmp_path / "out"))
    assert any((tmp_path / "out" / "pages").rglob("*.txt")) and any((tmp_path / "out" / "index").rglob("*.txt"))


PYTHON = "# Copyright\nimport os\n\nLIMIT = 3\n\n\n# A tree.\n@final\nclass Tree:\n    # walks it\n    def walk(self):\n        # inside\n        return 1\n\n\ndef free():\n    return 2\n"
XML = '<class name="Node" inherits="Object"><brief_description>A node.</brief_description><description></description><methods><method name="run"><return type="int"/><param index="0" name="n" type="int"/><description>Runs.</description></method></methods></class>'
JSON = '{"classes": [{"name": "AActor", "doc_comments": "An actor.", "methods": [{"name": "Tick", "return_type": "void", "doc_comments": "Each frame."}]}], "functions": [{"name": "Abs"}]}'


def routed(spark):
    rows = [
        (1, "src/tree.py", "class_ref", PYTHON),
        (2, "https://h.example/classes/class_node.html", "class_ref", "# Node\nA node. It runs.\n## Methods\nrun()"),
        (3, "doc/Node.xml", "class_ref", XML),
        (4, "doc/api.json", "class_ref", JSON),
        (5, "doc/guide.md", "guide", "# One\nfirst\n# Two\nsecond"),
        (6, None, None, "plain words"),
        (7, "src/data.py", "class_ref", "import os\r\nprint(1)"),
        (8, "doc/broken.xml", "class_ref", "no markup"),
        (9, "src/none.py", "class_ref", None),
        (10, "src/a.hlsl", "class_ref", "float4 f() { }"),
        (11, "src/b.go", "class_ref", "func Run() {\n}\ntype Box struct {\n}"),
    ]
    return spark.createDataFrame([(i, path, f"t{i}", kind, text, str(i)) for i, path, kind, text in rows], "doc_id long, path string, title string, doc_type string, raw_content string, content_hash string")


def test_every_document_is_chunked_by_its_kind(spark):
    chunks = {}
    for r in pipeline.route_chunks(routed(spark)).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r["doc_id"], []).append(r)
    names = {k: [(r["chunk_index"], r["chunk_type"], r["qualified_name"]) for r in rows] for k, rows in chunks.items()}
    assert names[1] == [(0, "constant", "tree.LIMIT"), (1, "class_overview", "tree.Tree"), (2, "method", "tree.Tree.walk"), (3, "method", "tree.free")]
    assert [r["content"] for r in chunks[1]] == ["LIMIT = 3", "# A tree.\n@final\nclass Tree:", "    # walks it\n    def walk(self):\n        # inside\n        return 1", "def free():\n    return 2"]
    assert names[2] == [(0, "class_overview", "t2")] and chunks[2][0]["content"].endswith("run()")
    assert names[3] == [(0, "class_overview", "Node"), (1, "method", "Node.run")]
    assert [n[2] for n in names[4]] == ["AActor", "AActor.Tick", "Global.Abs"]
    assert [n[2] for n in names[5]] == ["t5.One", "t5.Two"] and names[6] == [(0, "tutorial_section", "t6.t6")]
    assert names[7] == [(0, "class_overview", "t7")] and chunks[8][0]["content"] == "no markup" and names[10] == [(0, "method", "a.f")]
    assert [n[2] for n in names[11]] == ["b.Run", "b.Box"]
    assert set(chunks) == {1, 2, 3, 4, 5, 6, 7, 8, 10, 11}


def test_ingest_chunks_source_files_by_declaration(spark, tmp_path):
    store_path = str(tmp_path / "store")
    pipeline.run_ingest(spark, store_path, routed(spark).drop("doc_id"), "lib", "1")
    stored = store.Snapshots(spark, store_path).read("chunks")
    assert {r["qualified_name"] for r in stored.where("content LIKE '%def %'").collect()} == {"tree.Tree.walk", "tree.free"}
    assert stored.where("qualified_name = 'Copyright' OR heading = 'Copyright'").count() == 0


def test_code_scan(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "pkg/__init__.py": "y = 1\n", "node_modules/b.js": "z\n", "blank.go": " \n", "gen/skip_me.rs": "fn a() {}\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r["path"] for r in files.scan_code(spark, str(tmp_path), exclude_parts=["skip_me"]).collect()] == ["a.py"]


CHUNKS = "id string, source_name string, source_version string, chunk_type string, parent_name string, qualified_name string, heading string, summary string, content string, chunk_index int, embedding array<float>"


def chunks(spark):
    rows = [
        ("1", "s", "1", "class_overview", "Node", "Node", "", "A node.", "the lazy worker reads a shared buffer", 0, [1.0, 0.0]),
        ("2", "s", "1", "method", "Node", "Node.run", "", "", "buffers are shared by the lazy camera worker", 1, [0.8, 0.6]),
        ("3", "s", "1", "tutorial_section", "Guide", "Guide.Intro", "Intro", "Begin.", "nothing to see", 0, [0.0, 0.0]),
        ("4", "s", "2", "tutorial_section", "Guide", "Guide.Intro", "Intro", None, None, 0, None),
        ("5", None, None, "constant", None, None, None, None, "lazy worker", None, [0.0, 1.0]),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def test_search_grammar(spark):
    ids = lambda q: [r["id"] for r in search.text_search(chunks(spark), q).collect()]
    assert set(ids("shared buffer")) == {"1", "2"}
    assert set(ids('"lazy worker"')) == {"1", "5"}
    assert set(ids("lazy -camera")) == {"1", "5"}
    assert set(ids('intro or "shared buffer"')) == {"1", "3", "4"}
    assert ids("the and") == [] and ids("") == []


def test_nearest_leaves_out_unusable_vectors(spark):
    near = search.nearest(chunks(spark), [1.0, 0.0], 10).collect()
    assert [r["id"] for r in near] == ["1", "2", "5"]
    assert search.nearest(chunks(spark).limit(0), [1.0, 0.0]).count() == 0


def test_fusion_matches_dictionary_merge(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, place int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, place int")
    got = [(r["id"], r["retrieval"]) for r in search.fuse(a, b).collect()]
    assert got == [("y", "hybrid"), ("x", "keyword"), ("z", "semantic")]


def test_two_stage_and_lookup(spark):
    best = search.two_stage(chunks(spark), "shared buffer", [1.0, 0.0], k=2).collect()
    assert [r["id"] for r in best] == ["1", "2"] and best[0]["rerank_score"] == 1.0
    assert search.lookup(chunks(spark), "Guide.Intro").first()["id"] == "3"
    assert search.batches(chunks(spark), 1, "parent_name").select("batch_no").distinct().count() == 2


def test_export_kinds_and_pages(spark):
    kinds = {(r["source_version"], r["parent_name"]): (r["kind"], r["n_chunks"], r["summary"]) for r in export.parents(chunks(spark)).collect()}
    assert kinds == {("1", "Node"): ("class", 2, "A node."), ("1", "Guide"): ("tutorial", 1, "Begin."), ("2", "Guide"): ("tutorial", 1, "")}
    lines = [r["line"] for r in export.index_lines(chunks(spark)).where("source_version = '1'").orderBy("line_no").collect()]
    assert lines == ["- **Node** — A node.", "- **Guide** — Begin."]
    pages = export.page_lines(chunks(spark)).where("parent_name = 'Node'").orderBy("place").collect()
    assert [r["section"] for r in pages] == ["Overview", "Methods"]


def test_crawl_levels_take_the_shortest_way_and_stop_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y")], "source_url string, target_url string")
    got = {r["url"]: r["level"] for r in crawl.levels(edges, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_crawl_goes_as_deep_as_links_do_and_keeps_its_rules(spark):
    deep = spark.createDataFrame([(f"h.x/{i}", f"h.x/{i + 1}") for i in range(11)] + [("h.x/3", "o.x/1"), ("h.x/2", "h.x/private")], "source_url string, target_url string")
    seeds = spark.createDataFrame([("h.x/0",)], "url string")
    got = {r["url"]: r["level"] for r in crawl.levels(deep, seeds, exclude=["private"], same_host=True).collect()}
    assert got == {f"h.x/{i}": i for i in range(12)}


def test_ingest_search_and_export_end_to_end(spark, tmp_path):
    """Prose, code, XML and JSON go through chunking and embedding to hybrid search and to exported pages."""
    xml = '<class name="Node" inherits="Object"><brief_description>A node.</brief_description><methods><method name="run"><return type="int"/><description>Runs the lazy worker.</description></method></methods></class>'
    api = '{"classes": [{"name": "Mesh", "doc_comments": "A mesh of lazy triangles.", "methods": [], "properties": []}]}'
    rows = [
        ("guide.md", "Guide", "guide", "# Guide\nThe lazy worker reads a shared buffer.\n## More\nNothing else."), ("src/tree.py", None, "class_ref", 'class Tree:\n    def walk(self):\n        return self.buffer\n'),
        ("doc/Node.xml", None, "class_ref", xml), ("doc/mesh.json", None, "class_ref", api),
    ]
    scanned = spark.createDataFrame(rows, "path string, title string, doc_type string, raw_content string").withColumn("content_hash", F.md5("raw_content"))
    embed = lambda text: F.array(F.length(text).cast("float"), F.when(text.contains("worker"), 100.0).otherwise(0.0).cast("float"))
    root = str(tmp_path / "store")
    first = pipeline.run_ingest(spark, root, scanned, "lib", "1", embed=embed)
    assert first["documents"] == first["changed"] == 4
    changed = scanned.withColumn("raw_content", F.concat("raw_content", F.lit(" "))).withColumn("content_hash", F.md5("raw_content"))
    assert pipeline.run_ingest(spark, root, changed, "lib", "1", embed=embed, paths=scanned.where("path = 'guide.md'"))["changed"] == 1
    assert [(r["name"], r["version"]) for r in store.Snapshots(spark, root).read("sources").collect()] == [("lib", "1")]
    found = pipeline.run_search(spark, root, "lazy worker", [50.0, 100.0], k=5).collect()
    assert {r["retrieval"] for r in found} >= {"hybrid"} and found[0]["embedding"] is not None
    pipeline.run_export(spark, root, str(tmp_path / "out"))
    pages = "\n".join(p.read_text() for p in (tmp_path / "out" / "pages").rglob("part-*.txt"))
    assert "# Guide" in pages and "## Overview" in pages and "## Methods" in pages
    assert "- **run**" in "\n".join(p.read_text() for p in (tmp_path / "out" / "classes").rglob("part-*.txt"))


def test_plans_push_filters_and_prune_columns(spark, data):
    rows = search.matching(spark.read.parquet(f"{data}/chunks.parquet"), source_name="x", chunk_types=["method"]).select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_name,x)" in plan and "In(chunk_type" in plan or "EqualTo(chunk_type" in plan
    assert "embedding" not in plan.split("ReadSchema")[1]
    top = search.nearest(spark.read.parquet(f"{data}/embeddings.parquet"), [1.0] * 64, key="vec_id")
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
