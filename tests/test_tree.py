"""The source tree reader: order, pruning, planning by size, files that can't be read."""

import os

from riskloom.operators import frontends
from riskloom.sources import tree


def test_tree(spark, tmp_path):
    for name, data in {"b/Z.java": b"class Z {}", "a.java": "né".encode(), "b/bad.java": b"\xff\xfeok", "b/c/D.kt": b"fun d() {}", "skip.txt": b"no", "b/empty.java": b""}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(data)
    os.symlink(tmp_path / "nowhere", tmp_path / "src" / "b" / "lost.java")
    os.symlink(tmp_path / "src", tmp_path / "src" / "b" / "loop")
    tree.register(spark)
    read = lambda **o: spark.read.format("source_tree").options(**o).load(str(tmp_path / "src"))
    rows = read(patterns="*.java, *.kt").collect()
    assert [r.path for r in rows] == ["a.java", "b/Z.java", "b/bad.java", "b/c/D.kt", "b/empty.java", "b/lost.java"]
    by = {r.path: r for r in rows}
    assert by["a.java"].text == "né" and by["a.java"].size == 3 and by["b/bad.java"].text == "��ok" and by["b/empty.java"].text == ""
    assert by["b/lost.java"].text is None and "No such file" in by["b/lost.java"].error and all(r.error is None for r in rows[:-1])
    assert read().count() == 7 and read(bytespertask="1").rdd.getNumPartitions() == 7
    assert spark.read.format("source_tree").load(str(tmp_path / "none")).count() == 0


def test_planning_opens_nothing(tmp_path, monkeypatch):
    (tmp_path / "x.java").write_text("x" * 10)
    reader = tree.TreeReader({"path": str(tmp_path), "bytespertask": "100000"})
    monkeypatch.setattr("builtins.open", None)
    assert [p.names for p in reader.partitions()] == [[("x.java", 10)]]


def test_texts_are_parsed_once(spark):
    """What a query reads of the front ends lies in a table: no plan of it parses the texts again."""
    from riskloom.plans import code

    assert "MapInPandas" not in code.code_index(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_methods_without_calls():
    """Declarations are the same where calls are not asked for, however they are nested."""
    python = "class A:\n    def m(self, x):\n        try:\n            f(x)\n        except E:\n            def g(y):\n                return h(y)\n        match x:\n            case 1:\n                async def k(): pass\n        return lambda z: z\n"
    java = "package a;\nclass C { int m(int a) { return n(a); } class D { void o() {} } }"
    for path, text in (("a.py", python), ("C.java", java), ("a.go", "func f(a int) {\n g(a)\n}\n")):
        whole, some = frontends.rows_of(path, text), frontends.rows_of(path, text, calls=False)
        assert [r for r in whole if r["kind"] == "method"] == [r for r in some if r["kind"] == "method"] != []
        assert any(r["kind"] == "call" for r in whole) and not any(r["kind"] == "call" for r in some)
