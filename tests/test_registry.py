import pytest
from pyspark.sql import functions as F

from lignum import registry
from lignum.functions import paths


def test_registry_is_valid():
    registry.validate()
    assert len(registry.STYLES) == 35 and len(registry.LANGUAGES) == 103
    assert registry.by_extension()["py"] == "Python" and registry.by_name() == {"Dockerfile": "Dockerfile", "Makefile": "Makefile"}


@pytest.mark.parametrize(
    "languages",
    [
        {"A": registry.Language("c", ("x",), ()), "B": registry.Language("c", ("x",), ())},
        {"A": registry.Language("c", (), ("X",)), "B": registry.Language("c", (), ("X",))},
        {"A": registry.Language("unknown", ("x",), ())},
        {"A": registry.Language("c", (), ())},
        {"A": registry.Language("c", ("",), ())},
        {"A": registry.Language("c", ("a/b",), ())},
        {" ": registry.Language("c", ("x",), ())},
    ],
)
def test_bad_registries(languages):
    with pytest.raises(ValueError):
        registry.validate(languages)


def test_half_a_block_style():
    with pytest.raises(ValueError):
        registry.validate({}, {"x": registry.Style(None, "/*", None)})


def test_every_pattern_finds_its_language(spark):
    rows = [(f"a/b/x.{e}", n) for n, x in registry.LANGUAGES.items() for e in x.extensions] + [(f"a/{f}", n) for n, x in registry.LANGUAGES.items() for f in x.names]
    rows += [("x.PY", None), ("makefile", None), (".bashrc", None), ("noext", None), ("x.", None), ("a.b/c", None), (".htaccess", None), ("x.htaccess", "Apache Config"), ("a.py/Makefile", "Makefile")]
    df = spark.createDataFrame(rows, "path string, want string").withColumn("got", paths.language(F.col("path")))
    assert [tuple(r) for r in df.filter("not (got <=> want)").collect()] == []


def test_parts_of_paths(spark):
    rows = [("a\\b\\c.py",), ("",), ("x",), ("a/b.c.d",)]
    df = spark.createDataFrame(rows, "p string").withColumn("n", paths.normalized(F.col("p")))
    got = [tuple(r) for r in df.select("n", paths.base_name(F.col("n")), paths.parent(F.col("n")), paths.extension(F.col("n"))).collect()]
    assert got == [("a/b/c.py", "c.py", "a/b", "py"), (".", ".", "", None), ("x", "x", "", None), ("a/b.c.d", "b.c.d", "a", "d")]
