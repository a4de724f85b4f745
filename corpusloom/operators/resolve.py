"""From import texts to the files that they mean.

An import becomes candidate paths by its language's rules, all as Column expressions; candidates meet
the known files in one equi-join on (root, path). Go's folder imports join on the folders above each
file, never by a prefix comparison of all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..storage import stored, stored_counted

#: Suffixes that a script's import may leave out, in order.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: What an import names, by language.
PYTHON_MODULE = r"(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
PYTHON_NAME = r"import\s+([\w.]+)"
SCRIPT_SPEC = r"""(?:from|require\()\s*['"]([^'"]+)['"]"""
RUST_PATH = r"use\s+crate::([\w:]+)"
JAVA_CLASS = r"import\s+([\w.]+);"
C_HEADER = r'#include\s*"([^"]+)"'
GO_PACKAGE = r'"([^"]+)"'
#: These take more on purpose: a parenthesis before a Ruby file, blanks before a Go module's line.
RUBY_FILE = r"""require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]"""
GO_MODULE = r"(?m)^\s*module\s+(\S+)"


def _slashes(module: Column) -> Column:
    return F.replace(module, F.lit("."), F.lit("/"))


def _forms(base: Column, *templates: str) -> Column:
    return F.array(*[F.concat(*[base if p == "{}" else F.lit(p) for p in t.replace("{}", "\0{}\0").split("\0") if p]) for t in templates])


def _below(path: Column, spec: Column) -> Column:
    """A path beside ``path``; null if it leaves the root."""
    return paths.joined(paths.normal(F.concat(paths.folder(path), F.split(spec, "/"))))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null if there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _module(text: Column) -> Column:
    return F.when(text.rlike(PYTHON_MODULE), F.concat(F.regexp_extract(text, PYTHON_MODULE, 1), F.regexp_extract(text, PYTHON_MODULE, 2)))


def python(text: Column, path: Column) -> Column:
    module = _module(text)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.substring(module, dots + 1, F.length(module))
    rest = F.when(rest == "", _first(text, PYTHON_NAME)).otherwise(rest)
    depth = F.size(paths.folder(path))
    # each further dot goes up one folder and stops at the root; from the root there is no up
    up = F.when((depth == 0) & (dots > 1), None).otherwise(F.slice(paths.folder(path), 1, F.greatest(depth - dots + 1, F.lit(0))))
    beside = paths.joined(F.concat(up, F.split(_slashes(rest), "/")))
    return F.when(dots == 0, _forms(_slashes(module), "{}.py", "{}/__init__.py", "src/{}.py", "src/{}/__init__.py")).otherwise(_forms(beside, "{}.py", "{}/__init__.py"))


def script(text: Column, path: Column) -> Column:
    spec = _first(text, SCRIPT_SPEC)
    rel = F.when(spec.startswith("."), _below(path, spec))
    return _forms(rel, *["{}" + s for s in SCRIPT_SUFFIXES], *["{}/index" + s for s in SCRIPT_SUFFIXES])


def rust(text: Column, path: Column) -> Column:
    return _forms(F.replace(_first(text, RUST_PATH), F.lit("::"), F.lit("/")), "src/{}.rs", "src/{}/mod.rs")


def java(text: Column, path: Column) -> Column:
    return _forms(_slashes(_first(text, JAVA_CLASS)), "{}.java", "src/main/java/{}.java", "src/{}.java")


def c(text: Column, path: Column) -> Column:
    return _forms(_below(path, _first(text, C_HEADER)), "{}")


def ruby(text: Column, path: Column) -> Column:
    spec = _first(text, RUBY_FILE)
    beside = _below(path, spec)
    return F.when(text.contains("require_relative"), _forms(beside, "{}.rb", "{}")).otherwise(_forms(spec, "{}.rb", "lib/{}.rb"))


#: Candidates of each language; Go's need the files and are joined apart.
RULES = {"python": python, "javascript": script, "typescript": script, "rust": rust, "java": java, "c": c, "cpp": c, "ruby": ruby}


def candidates(text: Column, language: Column, path: Column) -> Column:
    """Paths that an import may mean, in order; none if it isn't understood."""
    none = F.array().cast("array<string>")
    out = none
    for lang, rule in RULES.items():
        out = F.when(language == lang, rule(text, path)).otherwise(out)
    return F.filter(F.coalesce(out, none), lambda x: x.isNotNull())


def is_relative(text: Column, language: Column) -> Column:
    """Whether an import is meant from its file's folder on, and so means nothing in another root."""
    own = F.when(language == "python", F.coalesce(_module(text).startswith("."), F.lit(False))).when(language == "ruby", text.contains("require_relative"))
    return F.coalesce(own.otherwise(language.isin("javascript", "typescript", "c", "cpp")), F.lit(False))


def go_modules(files: DataFrame) -> DataFrame:
    """Rows (root, dir, module) of the go.mod files among ``files`` (root, path, text)."""
    module = _first(F.col("text"), GO_MODULE)
    return files.where(paths.name(F.col("path")) == "go.mod").select("root", paths.joined(paths.folder(F.col("path"))).alias("dir"), module.alias("module")).where("module is not null")


def _folders(path: Column) -> Column:
    """Every folder above a path, the root as the empty one."""
    return F.transform(F.sequence(F.lit(0), F.size(paths.folder(path))), lambda i: paths.joined(F.slice(paths.folder(path), 1, i)))


def _go(imports: DataFrame, known: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports with the folder or file ``want`` that they mean, places of files by ``want``)."""
    go = imports.where("language = 'go'").withColumn("pkg", _first(F.col("import_text"), GO_PACKAGE)).where(F.col("pkg").contains("/"))
    # the module file in the nearest folder above, which is the same for all files of a folder
    go = go.withColumn("_at", paths.joined(paths.folder(F.col("path"))))
    above = go.select("root", "_at", F.explode(_folders(F.col("path"))).alias("dir")).distinct().join(modules, ["root", "dir"])
    nearest = above.groupBy("root", "_at").agg(F.max_by("module", F.length("dir")).alias("module"))
    go = go.join(nearest, ["root", "_at"], "left")
    inside = F.when(F.col("pkg") == F.col("module"), F.lit("")).when(F.col("pkg").startswith(F.concat("module", F.lit("/"))), F.substring("pkg", F.length("module") + 2, F.length("pkg"))).otherwise(F.col("pkg"))
    go = go.select(*_IMPORT, F.btrim(inside, F.lit("/")).alias("want"))
    files = known.where(F.col("file").endswith(".go"))
    places = F.array_distinct(F.concat(_folders(F.col("file")), F.array(F.regexp_replace("file", r"\.go$", ""))))
    return go, files.select("target_root", "file", F.explode(places).alias("want"))


_IMPORT = ("root", "path", "pos", "import_text")
_PLACE = ["target_root", "want"]
#: Imports of a folder and files in it that meet in one place, and those of these files that come together. Spark
#: holds the pairs of a run with all imports of its block at once.
BLOCK, RUN = 2048, 64
#: Pairs of an import and a file for a task, until there are so many tasks.
PAIRS, TASKS = 4_000_000, 2_000


def _one(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` (imports with target_root and want) with each ``file`` of ``right`` (target_root, want, file)
    there; few rows of ``right`` share a place."""
    return left.join(right, _PLACE)


def _many(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``_one`` where many imports mean a folder of many files, so that there are far more pairs
    than rows of either side. A folder's imports and files are dealt into blocks, which go to tasks by the
    number of pairs, not by the bytes that are shuffled; a task holds one block's imports, whatever the
    folder has. Rows come as a run of files for one import after the other, which a columnar format keeps
    in a fifth of a byte each."""
    asked = left.groupBy(*_PLACE).agg(F.count("*").alias("_imports"))
    folders = right.groupBy(*_PLACE).agg(F.count("*").alias("_files")).join(asked, _PLACE).withColumn("_folder", F.monotonically_increasing_id())
    folders, (n,) = stored_counted(folders, "folders")
    if not n:
        return left.where("false").withColumn("file", F.lit(None).cast("string"))
    pairs = folders.agg(F.sum(F.col("_imports").cast("double") * F.col("_files"))).first()[0]
    tasks = min(int(pairs // PAIRS) + 1, TASKS)
    folders = F.broadcast(folders) if n <= BROADCAST else folders
    blocks = {c: F.ceil(F.col(c) / BLOCK).cast("int") for c in ("_imports", "_files")}
    number = lambda n, *by: F.pmod(F.xxhash64(*by), blocks[n]).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks[n] - 1))
    # a folder's number and not its names: of these Spark takes one that is the same for all out of the join's key, and deals anew, by bytes
    keys = ["_folder", "_a", "_b"]

    def dealt(rows: DataFrame, a: Column, b: Column) -> DataFrame:
        return rows.join(folders, _PLACE).withColumn("_a", a).withColumn("_b", b).repartition(tasks, *keys)

    files = dealt(right, each("_imports"), number("_files", "file")).groupBy(*keys).agg(F.collect_list("file").alias("_all"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / RUN).cast("int")), lambda i: F.slice("_all", i * RUN + 1, RUN))
    # a merge join goes through its left side, the runs, and gives each all imports of its block
    met = files.select(*keys, F.explode(runs).alias("_run")).hint("merge").join(dealt(left, number("_imports", "path", "pos"), each("_files")), keys)
    return met.select(*_IMPORT, "target_root", F.explode("_run").alias("file"))


def resolve(imports: DataFrame, files: DataFrame, modules: DataFrame | None = None, roots: Sequence[str] | None = None) -> DataFrame:
    """Rows (root, path, pos, import_text, target_root, file) for each file that an import of
    ``imports`` (root, path, language, pos, import_text) means among ``files`` (root, path).

    With ``roots``, an import that means nothing in its own root is looked up in the others, in the order
    given, and the first root that knows it wins; relative imports stay in their own. Of each path only the
    first root that has it meets the imports, so that these are not multiplied by roots: an import's own
    root is none of those that have its paths, or it would have been found there.
    """
    known = files.select(F.col("root").alias("target_root"), F.col("path").alias("file")).distinct()
    modules = modules if modules is not None else imports.sparkSession.createDataFrame([], "root string, dir string, module string")

    def meant(rows: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """(imports with each path ``want`` that they may mean, files by ``want``): of most languages, and of Go."""
        paths_ = F.array_distinct(candidates(F.col("import_text"), F.col("language"), F.col("path")))
        return [(rows.where("language <> 'go'").select(*_IMPORT, F.explode(paths_).alias("want")), known.withColumn("want", F.col("file"))), _go(rows, known, modules)]

    meet, here = (_one, _many), [(left.withColumn("target_root", F.col("root")), right) for left, right in meant(imports)]
    own = reduce(DataFrame.unionByName, [join(left, right).select(*_IMPORT, "target_root", "file") for join, (left, right) in zip(meet, here, strict=True)])
    if not roots:
        return own
    keys = ["root", "path", "pos"]
    closed = reduce(DataFrame.unionByName, [left.join(right, _PLACE, "left_semi").select(*keys) for left, right in here])
    order = imports.sparkSession.createDataFrame([(r, i) for i, r in enumerate(dict.fromkeys(map(str, roots)))], "target_root string, place int")
    open_ = imports.where(~is_relative(F.col("import_text"), F.col("language"))).join(closed.distinct(), keys, "left_anti")
    found = []
    for join, (left, right) in zip(meet, meant(open_), strict=True):
        first = right.join(order, "target_root").groupBy("want").agg(F.min(F.struct("place", "target_root")).alias("first"))
        best = left.join(first, "want").groupBy(*keys).agg(F.min("first")["target_root"].alias("target_root"))
        found.append(join(left.join(best, keys), right).select(*_IMPORT, "target_root", "file"))
    return reduce(DataFrame.unionByName, [own, *found])


#: Names, the most frequent ones, and paths that go to every task at once.
BROADCAST = 100_000


def used_names(files: DataFrame) -> DataFrame:
    """Rows (path, name) of ``files`` (path, text), each once. A file's names are distinct in its own array, so
    only those of paths that several rows have are compared with each other."""
    again, (n,) = stored_counted(files.groupBy("path").count().where("count > 1").select(F.col("path").alias("again")), "paths_again")
    names = files.select("path", F.explode(tx.used_names(F.col("text"))).alias("name"))
    if not n:
        return names
    again = F.broadcast(again) if n <= BROADCAST else again
    same = names.join(again, F.col("path").eqNullSafe(F.col("again")), "left_semi").distinct()
    return names.join(again, F.col("path").eqNullSafe(F.col("again")), "left_anti").unionAll(same)


def cross_references(symbols: DataFrame, usages: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows (symbol, defined_in, used_in): a used name of ``usages`` (path, name) means the symbol of
    ``symbols`` (path, name) with that name in the least path; own symbols make no row. ``distinct``: each row
    of ``usages`` is there once.

    The most frequent names, which make up most of the rows, meet their symbols in the task that reads them;
    only the others are shuffled."""
    defined = symbols.where(F.btrim("name") != "").groupBy("name").agg(F.min("path").alias("defined_in"), F.count("*").alias("_n"))
    defined, (n,) = stored_counted(defined, "defined")
    used = usages.select("name", F.col("path").alias("used_in"))
    used = used if distinct else used.distinct()
    if n <= BROADCAST:
        met = used.join(F.broadcast(defined.drop("_n")), "name")
    else:
        often = stored(defined.orderBy(F.desc("_n")).limit(BROADCAST).drop("_n"), "frequent_names")
        near = used.join(F.broadcast(often), "name", "left")
        rest = near.where("defined_in is null").drop("defined_in").join(defined.drop("_n"), "name")
        met = near.where("defined_in is not null").select("name", "used_in", "defined_in").unionByName(rest)
    return met.where("used_in <> defined_in").select(F.col("name").alias("symbol"), "defined_in", "used_in")
