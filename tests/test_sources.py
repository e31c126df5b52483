import json

from pyspark.sql import functions as F

from scriptorium.sources import api, markup
from scriptorium.streaming import incremental

XML = """<class name="Lamp" inherits="Node"><brief_description>A lamp.</brief_description><description>It shines. Brightly.</description>
<methods><method name="glow"><return type="int"/><param index="0" name="level" type="int" default="3"/><description>Glows a while. Then stops.</description></method><method><return type="void"/></method></methods>
<members><member name="colour" type="Color" default="red">Colour of the lamp.</member></members>
<signals><signal name="burnt"><param index="0" name="when" type="float"/><description>Sent once.</description></signal></signals>
<constants><constant name="MODE_A" value="0" enum="Mode">First.</constant><constant name="MAX" value="9">Most.</constant></constants></class>"""


def test_xml_classes(spark, tmp_path):
    (tmp_path / "lamp.xml").write_text(XML)
    got = {r["qualified_name"]: r for r in api.scan_xml(spark, str(tmp_path)).collect()}
    assert {k: r["chunk_type"] for k, r in got.items()} == {"Lamp": "class_overview", "Lamp.glow": "method", "Lamp.colour": "property", "Lamp.burnt": "signal", "Lamp.MODE_A": "enum", "Lamp.MAX": "constant"}
    assert got["Lamp.glow"]["content"].startswith("int glow(int level = 3)") and got["Lamp.glow"]["summary"] == "Glows a while."
    assert got["Lamp.colour"]["content"].startswith("Color colour = red")


def test_json_api(spark, tmp_path):
    method = {"name": "Tick", "return_type": "void", "arguments": [{"value_type": "float", "name": "dt", "default_value": None}], "is_static": False, "is_virtual": True, "is_const_this": True, "is_override": False, "doc_comments": "Runs."}
    (tmp_path / "api.json").write_text(json.dumps({"classes": [{"name": "AActor", "doc_comments": "An actor.", "methods": [method], "properties": [{"name": "Speed", "value_type": "float", "default_value": "1.0"}]}], "structs": [], "enums": [{"name": "EMode", "variants": ["A", "B"]}], "functions": [{**method, "name": "Spawn"}]}))
    got = {r["qualified_name"]: r["content"] for r in api.scan_json(spark, str(tmp_path / "api.json")).collect()}
    assert got["AActor.Tick"].startswith("Tick(float dt) -> void [virtual, const]") and got["AActor.Speed"].startswith("Speed: float = 1.0")
    assert set(got) == {"AActor", "AActor.Tick", "AActor.Speed", "EMode.EMode", "Global.Spawn"}


def test_html(spark):
    html = "<html><head><title> A  page </title><script>var a = '</p>';</script></head><body><nav>menu</nav><main><h1>Top</h1><p>One &amp; two.<p>Three <a href='/x#y'>link</a><ul><li>item</ul></main><footer>foot</footer></body></html>"
    r = spark.createDataFrame([(html,)], "h string").select(markup.html_title(F.col("h")), markup.html_to_markdown(F.col("h")), markup.html_links(F.col("h"))).first()
    assert r[0] == "A page" and r[1] == "# Top\nOne & two.\nThree link\n- item" and r[2] == ["/x"]


def test_incremental_documents(spark, tmp_path):
    schema = "doc_id long, source_id string, path string, title string, doc_type string, raw_content string, content_hash string, updated_at timestamp"
    row = lambda i, path, h, day: (i, "s", path, "t", "guide", h, h, f"2024-01-{day:02d} 00:00:00")
    make = lambda rows: spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("updated_at", F.to_timestamp("updated_at"))
    args = (spark, str(tmp_path / "in"), make([row(1, "a", "x", 1)]).schema, str(tmp_path / "store"), str(tmp_path / "state"))
    make([row(1, "a", "x", 1), row(2, "b", "y", 1), row(3, "a", "z", 2)]).write.parquet(str(tmp_path / "in"), mode="append")
    incremental.index_documents(*args)
    make([row(4, "b", "y", 3), row(5, "c", "w", 3)]).write.parquet(str(tmp_path / "in"), mode="append")
    incremental.index_documents(*args)
    from scriptorium.operators.store import Snapshots

    got = {r["path"]: r["content_hash"] for r in Snapshots(spark, str(tmp_path / "store")).read("documents").collect()}
    assert got == {"a": "z", "b": "y", "c": "w"}
