import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import chunking, symbols


def pack(text, most):
    if len(text) <= most:
        return [text.strip()]
    parts, current = [], ""
    for p in text.split("\n\n"):
        if current and len(current) + len(p) + 2 > most:
            parts.append(current.strip())
            current = p
        else:
            current = p if current == "" else current + "\n\n" + p
    if current.strip():
        parts.append(current.strip())
    return parts


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc\n", "word ", "\n\n", "x" * 30]), max_size=25).map("".join), min_size=1, max_size=20))
def test_oversize_split_is_greedy(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", chunking.split_oversize(F.col("t"), 40).alias("p")).collect():
        assert r["p"] == pack(r["t"], 40)


def test_sections_and_chunks(spark):
    text = "intro\n# One\nbody one\n\n## Two\n\n### Three\nlast\n#### four stays\n" + "\r\n# Five\r\n" + "\n\n".join(["p" * 900] * 5)
    df = spark.createDataFrame([(1, "a.md", None, text), (2, "b.md", "Given", ""), (3, "c.md", "Given", None), (4, "d.md", "Given", "no heading")], "doc_id long, path string, title string, raw_content string")
    got = [tuple(r) for r in chunking.sections(df).where("doc_id = 1").select("section_no", "heading", F.substring("body", 1, 8)).orderBy("section_no").collect()]
    assert got == [(0, "", "intro"), (1, "One", "body one"), (3, "Three", "last\n###"), (4, "Five", "pppppppp")]
    chunks = chunking.chunk_text(df).orderBy("doc_id", "chunk_index").collect()
    assert [r["chunk_index"] for r in chunks if r["doc_id"] == 1] == [0, 100, 300, 400, 401, 402]
    assert [r["qualified_name"] for r in chunks if r["doc_id"] == 1][-1] == "One.Five.2"
    assert [(r["qualified_name"], r["content"]) for r in chunks if r["doc_id"] == 4] == [("Given.Given", "no heading")]
    assert all(len(r["content"]) <= 2000 for r in chunks)


def test_declarations(spark):
    code = {
        "a.py": "class A(B):\n    def run(self, x):\n        pass\n\nasync def top():\n    pass\nLIMIT = 3\n",
        "b.rs": "pub struct P {\n}\nimpl P {\n    pub fn go(&self) -> u32 {\n    }\n}\nconst N: u32 = 3;",
        "c.go": "type T struct{}\nfunc (t *T) Run(a int) int {\n}\nconst K = 2",
        "d.ts": "export class C {\n}\nexport function f(a: number): string {\n}",
        "e.cpp": "class D {\n    int run(size_t a) {\n    }\n};\n",
        "f.gd": "class_name G\nfunc go(a: int) -> int:\nconst X = 1\nsignal done",
        "g.frag": "#define Q 1\nvec4 shade(float a) {\n}\nvoid main() {\n}",
        "https://h.example/i.py": "def page():\n",
    }
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(code.items())], "doc_id long, path string, raw_content string")
    found = symbols.with_parents(symbols.declarations(df)).collect()
    assert {(r["language"], r["kind"], r["name"], r["parent"]) for r in found if r["kind"] == "method"} == {
        ("python", "method", "run", "A"), ("python", "method", "top", "A"), ("rust", "method", "go", "P"), ("go", "method", "Run", "T"), ("typescript", "method", "f", "C"),
        ("cpp", "method", "run", "D"), ("gdscript", "method", "go", "G"), ("glsl", "method", "shade", None), ("glsl", "method", "main", None),
    }
    assert {r["name"] for r in found if r["kind"] == "constant"} == {"LIMIT", "N", "K", "X", "Q"}
    assert not any(re.match("page", r["name"]) for r in found)
