from pyspark.sql import functions as F

from codemap.functions import paths as P


def _eval(spark, paths, expr):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return [r[0] for r in df.select(expr(F.col("path"))).collect()]


def test_extension_is_whole_path(spark):
    assert _eval(spark, ["a.b/c", "x.PY", "Makefile", "src/app.py"], P.extension) == [".b/c", ".PY", "", ".py"]


def test_skip_checks_filename_and_is_case_sensitive(spark):
    got = _eval(spark, ["node_modules/a.js", "src/build", "Build/a.py", "logo.png", "a.PNG", "poetry.lock"], P.should_skip)
    assert got == [True, True, False, True, False, True]


def test_signal_and_noise(spark):
    assert _eval(spark, ["README.md", "docs/README.md", "readme.md"], P.is_signal) == [True, True, False]
    got = _eval(spark, ["tests/a.py", "src/Tests/a.py", "tests", "src/test_x.py", "a_test.py", "x.spec.js", "conftest.py", "src/app.py"],
                P.is_noise)
    assert got == [True, True, False, True, True, True, True, False]


def test_penalty_substring_first(spark):
    got = _eval(spark, ["latests/a.py", "src/docs/x.py", "README.md", "setup.cfg", "src/app.py", "test_x.md"], P.path_penalty)
    assert got == [0.2, 0.2, 0.5, 0.5, 1.0, 0.2]


def test_language_and_depth(spark):
    assert _eval(spark, ["a.py", "b.tsx", "c.txt", "d.cs"], P.language) == ["python", "typescript", None, "c_sharp"]
    assert _eval(spark, ["a", "a/b", "a/b/c.py"], P.depth) == [0, 1, 2]
    assert _eval(spark, ["a", "a/b", "a/b/c.py"], P.dirname) == ["", "a", "a/b"]
