"""Column builders and settings, on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import globs, paths
from corpusloom.functions import text as tx


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


LAYERS = ["*.log", "build/", "docs/", "!docs/keep.md", "# note", "", "/top.txt", "a/**/z", "name?.py", "[ab]c"]
PATHS = {
    "x.log": True, "src/x.log": True, "build/a/b.py": True, "src/build/c.py": True, "src/main.py": False, "data.txt": False, "docs/keep.md": True, "docs": False, "top.txt": True, "sub/top.txt": False,
    "a/z": True, "a/q/r/z": True, "b/a/z": False, "name1.py": True, "name12.py": False, "q/ac": True, "cc": False, "log": False,
}


def test_ignore_rules(spark):
    rules = globs.parse_rules(LAYERS)
    assert {p: globs.ignored_path(p, rules) for p in PATHS} == PATHS
    assert values(spark, list(PATHS), globs.ignored(F.col("x"), rules)) == list(PATHS.values())


def test_a_later_layer_can_take_back(spark):
    rules = globs.parse_rules(["*.txt", "!data.txt"])
    assert values(spark, ["a.txt", "data.txt"], globs.ignored(F.col("x"), rules)) == [True, False]
    assert globs.parse_rules(["\\#x"])[0].regex.endswith("#x/?$") or globs.ignored_path("#x", globs.parse_rules(["\\#x"]))


def test_sensitive_names(spark):
    given = [".env", "a/.env.local", "k.pem", "id_rsa", "src/id_rsa.py", "service-account-9.json", "credentials.json", "x.json"]
    assert values(spark, given, globs.sensitive(F.col("x"), config.SENSITIVE)) == [True, True, True, True, False, True, True, False]


def test_path_parts(spark):
    given = ["a/b/c.test.py", "x", ".env", "d/.hidden", "d/f.PY"]
    assert values(spark, given, paths.suffix(F.col("x"))) == [".py", "", "", "", ".PY"]
    assert values(spark, given, paths.stem(F.col("x"))) == ["c.test", "x", ".env", ".hidden", "f"]
    assert values(spark, given, paths.language(F.col("x"))) == ["python", "unknown", "unknown", "unknown", "unknown"]
    assert values(spark, ["a/./b/../c", "../x", "a/../../b", ""], paths.joined(paths.normal(F.split("x", "/")))) == ["a/c", None, None, ""]


def test_config_files(spark):
    given = [("pyproject.toml", False), ("a/x.json", False), ("a/x.json", True), ("package.json", True), ("a/x.YML", True), ("a/x.py", False)]
    got = spark.createDataFrame(given, "p string, i boolean").select(paths.is_config(F.col("p"), F.col("i"))).collect()
    assert [r[0] for r in got] == [True, True, False, True, True, False]


def test_watched_paths(spark):
    given = ["src/a.py", "a/uv.lock", "__pycache__/a.py", "a.pyc", "README.md", "x/package-lock.json", "lib/x.TS"]
    assert values(spark, given, paths.is_watched(F.col("x"))) == [True, False, False, False, False, False, True]


def test_binary_content(spark):
    whole, cut = "é" * 4096, "a" + "é" * 4096  # the second has a letter over the edge of the probe
    rows = [bytearray(b"abc\0d"), bytearray(b"ok"), bytearray(b"\xff\xfe"), bytearray(whole.encode() + b"\0"), bytearray(cut.encode()), bytearray(b"")]
    assert values(spark, rows, tx.is_binary(F.col("x")), "x binary") == [True, False, True, False, True, False]


def test_line_counts(spark):
    assert values(spark, ["", "a", "a\n", "a\nb"], tx.line_count(F.col("x"))) == [0, 1, 2, 2]


@pytest.mark.parametrize(
    ("signature", "short"),
    [
        ("def f(a, b)", "def f(a, b)"),
        ("x" * 130, "x" * 117 + "..."),
        ("def f(" + ", ".join(f"argument{i}" for i in range(20)) + ") -> int", "def f(" + ", ".join(f"argument{i}" for i in range(9)) + ", ...) -> int"),
        ("def f(" + "a" * 130 + ")", "def f(...)"),
    ],
)
def test_short_signatures(spark, signature, short):
    assert values(spark, [signature], tx.short_signature(F.col("x"))) == [short]


def test_bases_and_docstrings(spark):
    assert values(spark, ["class A(B, C[D])", "class A", "class A()"], tx.bases(F.col("x"))) == ["B, C[D]", "", ""]
    assert values(spark, ['"""Doc.\nmore"""\nx', "'''q'''", "x = 1"], tx.module_docstring(F.col("x"))) == ["Doc.\nmore", "q", None]


def test_summary_line_and_excerpt(spark):
    assert values(spark, ["### h\n\n```py\n x = 1\n```", "", "###\n```"], tx.summary_line(F.col("x"))) == ["x = 1", "", ""]
    assert values(spark, ["# T\n\none\n two\n\nthree", "", "# only"], tx.excerpt(F.col("x"))) == ["one two", "", ""]


def test_since():
    assert tx.parse_since("7 days ago", 700_000) == 700_000 - 7 * 86400
    assert tx.parse_since("2024-01-02", 0) == tx.parse_since("2024-01-02T02:00:00+02:00", 0) == 1704153600
    assert tx.parse_since("whenever", 0) is None


def test_profiles():
    for task in [*config.PROFILES, "other"]:
        assert abs(sum(config.weights(task).values()) - 1) < 1e-12
        assert abs(sum(config.weights(task, True).values()) - 0.8) < 1e-12
    assert config.weights("other") == config.weights("default")


def test_settings(tmp_path):
    assert config.load_config(tmp_path) == config.Config()
    (tmp_path / "pyproject.toml").write_text('[tool.corpusloom]\ntoken_budget = 5\ntask = "debug"\n')
    assert config.load_config(tmp_path).token_budget == 5
    (tmp_path / ".corpusloom.toml").write_text('token_budget = 7\nextra_ignore = ["x"]\nno_git = true\n')
    got = config.load_config(tmp_path, task="feature", layers=None)
    assert (got.token_budget, got.task, got.extra_ignore, got.no_git, got.layers) == (7, "feature", ("x",), True, False)
    (tmp_path / ".corpusloom.toml").write_text("[corpusloom]\ntoken_budget = 9\n")
    assert config.load_config(tmp_path).token_budget == 9
