import pytest
from pyspark.sql import functions as F

from riskloom.functions import cvss, globs
from riskloom.functions import scalars as X
from riskloom.functions.masking import arguments, is_cpp, mask

PUBLISHED = {
    "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
    "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N": 7.5,
    "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
    "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N": 5.9,
    "AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:H": 8.8,
    "AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H": 7.8,
    "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H": 8.1,
    "AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:L/A:L": 3.5,
    "AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0,
    "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
}


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_published_scores(spark):
    assert values(spark, cvss.base_score("v"), [(v,) for v in PUBLISHED], "v string") == list(PUBLISHED.values())


def test_bands(spark):
    assert values(spark, cvss.band("s"), [(x,) for x in (10.0, 9.0, 8.9, 7.0, 6.9, 4.0, 3.9, 0.1, 0.0)], "s double") == ["critical"] * 2 + ["high"] * 2 + ["medium"] * 2 + ["low"] * 2 + ["none"]


def test_worst_vector(spark):
    df = spark.createDataFrame([(["CWE-89", "CWE-327"],), (["CWE-1"],), ([],)], "cwe_ids array<string>")
    assert [r.cvss_score for r in cvss.with_vector(df).collect()] == [9.8, 7.5, 7.5]


def test_scope(spark):
    ids = X.cwe_ids(F.col("c"))
    rows = [(["CWE-327: x"],), (["CWE-89 : y", "cwe-327"],), ([],), (None,), ([""],)]
    assert values(spark, X.in_scope(ids, ["CWE-327"]), rows, "c array<string>") == [False, True, True, True, True]
    assert values(spark, F.array_join(ids, ","), rows, "c array<string>") == ["CWE-327", "CWE-89,CWE-327", "", "", ""]


def test_types_and_places(spark):
    assert values(spark, X.vuln_type(F.col("c")), [(["CWE-89: SQL ('SQL Injection')"],), (["CWE-1"],), ([],), (None,)], "c array<string>") == ["SQL Injection", "CWE-1", "Uncategorized", "Uncategorized"]
    assert values(spark, X.short_location(F.col("p")), [("a\\b\\c.x",), ("a/b",), ("x",), ("/a//b/c",)], "p string") == [".../b/c.x", "a/b", "x", ".../b/c"]


def test_risk(spark):
    rows = [(v, b) for v in ("yes", "no", "uncertain", "unverified") for b in ("critical", "low", "none")]
    assert values(spark, X.risk_level(F.col("v"), F.col("b")), rows, "v string, b string") == ["critical", "low", "none", "low", "low", "low", "high", "low", "low", "high", "low", "low"]


def test_small_functions(spark):
    one = lambda c, v: values(spark, c, [(v,)], "x string")[0]
    x = F.col("x")
    assert one(X.masked_key(x), "sk-123456789") == "sk-1****6789" and one(X.masked_key(x), "short") == "*****"
    assert [one(X.c_integer(x), v) for v in ("0x10", "010", "42UL", "n")] == [16, 8, 42, None]
    assert one(X.camelize(x), "user_account") == "UserAccount"
    assert one(X.without_fences(x), "```json\n{}\n```") == "{}"
    assert one(X.short_type(x), "const std::string &") == "string"
    assert one(X.one_line(x), " a \n\t b ") == "a b"
    assert one(X.safe_stem(x), "a/b: c?") == "ab c" and one(X.safe_stem(x), "//") == "report"
    assert [one(X.language(x), v) for v in ("abc", "漏洞 a", "", None)] == ["en", "zh", "en", "en"]
    assert one(X.line_of(x, F.lit(3)), "a\nb\nc") == 2
    assert values(spark, X.retry_delay(F.col("a")), [(a,) for a in (1, 2, 3, 4, 9)], "a int") == [0, 2, 4, 8, 30]


@pytest.mark.parametrize(
    "path,patterns,out",
    [("a/target/x.java", ["target"], True), ("a/targets/x", ["target"], False), ("src/it/x", ["src/it"], True), ("src/a/it/x", ["src/it"], False), ("w/a.min.js", ["*.min.js"], True), ("a\\bin\\c", ["**/bin/**"], True), ("a/b", [], False), ("x/v1/y", ["v[0-9]"], True), ("x/va/y", ["v[!0-9]"], True)],
)
def test_globs(spark, path, patterns, out):
    assert values(spark, globs.excluded(F.col("p"), patterns), [(path,)], "p string") == [out]


def test_masking():
    code = 'a("x // y"); // c\n/* d\n */ b'
    assert mask(code) == 'a("      ");     \n    \n    b' and len(mask(code)) == len(code)
    assert '"x // y"' in mask(code, literals=False)
    assert mask("x = 'a#b' # c", hash_comments=True).rstrip() == "x = '   '"
    assert [code_[a:e].strip() for code_ in ["f(a, g(b, c), [d, e])"] for a, e in arguments(code_, 1)[0]] == ["a", "g(b, c)", "[d, e]"]
    assert is_cpp("x.cc", "") and is_cpp("x.h", "class A {};") and not is_cpp("x.h", "// class\nint f();") and not is_cpp("x.c", "class")
