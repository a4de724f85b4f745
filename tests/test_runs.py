"""Sources, kept results, streams, whole runs and the command line, on temporary trees."""

import base64
import datetime
import http.server
import json
import random
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom import cli, config
from corpusloom.functions import tokens as bpe
from corpusloom.plans import analyze as plan
from corpusloom.plans import providers
from corpusloom.sources import cache, repo_files
from corpusloom.streaming import debounce, watcher

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {
        "src/pkg/__init__.py": '"""A package."""\n', "src/pkg/main.py": '"""Starts it."""\nfrom .utils import helper\nfrom pkg import config\n\n\ndef main():\n    return helper(config.LIMIT)\n',
        "src/pkg/utils.py": "from . import config\n\n\ndef helper(x):\n    return Thing(x)\n\n\nclass Thing:\n    def m(self): ...\n", "src/pkg/config.py": "LIMIT = 3\n",
        "src/pkg/_private/deep.py": "def lonely(): ...\n", "tests/test_main.py": "from pkg.main import main\n\n\ndef test(): main()\n", "README.md": "# Read\n\nme\n", "pyproject.toml": "[x]\n", ".gitignore": "*.log\nout/\n",
        "a.log": "x", "out/gen.py": "x = 1\n", "node_modules/lib.js": "x", "src/pkg/__pycache__/m.pyc": "x", "keys/id_rsa": "secret",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "image.png").write_bytes(b"\x89PNG\0")
    (root / "bad.txt").write_bytes(b"\xff\xfe\xfd")
    (root / "link.py").symlink_to(root / "README.md")
    return root


KEPT = {".gitignore", "README.md", "pyproject.toml", "src/pkg/__init__.py", "src/pkg/_private/deep.py", "src/pkg/config.py", "src/pkg/main.py", "src/pkg/utils.py", "tests/test_main.py"}


def test_tree_scan(spark, tree):
    files = repo_files.files(spark, [str(tree)])
    assert {r.path for r in files.collect()} == KEPT | {"keys/id_rsa"}
    got = {r.path: r for r in plan.scan(spark, [str(tree)], config.Config(extra_ignore=("README.md",), output_file="pyproject.toml")).collect()}
    assert set(got) == KEPT - {"README.md", "pyproject.toml"}
    main = got["src/pkg/main.py"]
    assert (main.name, main.ext, main.language, main.size) == ("main.py", ".py", "python", len((tree / "src/pkg/main.py").read_bytes()))


def test_two_roots(spark, tree):
    got = repo_files.files(spark, [str(tree / "src"), str(tree / "tests")])
    assert {(r.root.rsplit("/", 1)[1], r.path) for r in got.where("language = 'python'").collect()} >= {("src", "pkg/main.py"), ("tests", "test_main.py")}
    assert repo_files.files(spark, [str(tree / "missing")]).count() == 0


def test_two_roots_with_the_same_paths(spark, tmp_path):
    """Every file once, under its root's label; imports prefer the own root; commits go to their own file."""
    a, b = tmp_path / "x/app", tmp_path / "y/app"
    for root, files in ((a, {"src/main.py": "from . import u\nimport only_b\n", "src/u.py": "A = 1\n"}), (b, {"src/main.py": "from . import u\n", "src/u.py": "B = 1\n", "only_b.py": "C = 1\n"})):
        for path, text in files.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_text(text)
    git(b, "init", "-q")
    git(b, "add", "src/main.py")
    git(b, "commit", "-qm", "one")
    kept = f"file://{tmp_path}/kept"
    for _ in range(2):  # the second time from what is kept
        stages = plan.analyze(spark, [str(a), str(b)], config.Config(query="u", task="feature"), as_of=1e9, encode=cli.hashed_words, kept=kept)
        paths = sorted(r.path for r in stages.included.collect())
        assert paths == ["@app-2/only_b.py", "@app-2/src/main.py", "@app-2/src/u.py", "@app/src/main.py", "@app/src/u.py"]
        assert {(r.src, r.dst) for r in stages.edges.collect()} == {("@app/src/main.py", "@app/src/u.py"), ("@app/src/main.py", "@app-2/only_b.py"), ("@app-2/src/main.py", "@app-2/src/u.py")}
        got = {r.path: r for r in stages.signals.collect()}
        assert len(got) == stages.signals.count() == 5 and {p for p, r in got.items() if r.freq} == {"@app-2/src/main.py"}
        assert {round(1 / r.depth) for r in got.values()} == {2, 3}
    text = plan.write(stages, str(a), config.Config(), as_of=1e9)
    assert "`@app-2/src/main.py`" in text and "`@app/src/main.py`" in text
    assert spark.read.parquet(f"{kept}/vectors").count() == 5
    one, two = (plan.manifest_of(spark, roots, config.Config())["files"] for roots in ([str(a), str(b)], [str(a), str(a)]))
    assert one != two


def git(root, *args, date="2024-01-01T00:00:00"):
    subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@x", *args], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": "/tmp"})


def test_commit_log(spark, tree):
    known = repo_files.files(spark, [str(tree)])
    assert {r.commit_count for r in repo_files.change_stats(repo_files.commits(spark, str(tree)), known).collect()} == {0}
    git(tree, "init", "-q")
    assert repo_files.commits(spark, str(tree)).count() == 0  # no commit yet
    git(tree, "add", "src", "README.md")
    git(tree, "commit", "-qm", "first")
    (tree / "README.md").write_text("changed")
    git(tree, "commit", "-qam", "second", date="2024-01-05T00:00:00")
    log = repo_files.commits(spark, str(tree))
    stats = {r.path: r for r in repo_files.change_stats(log, known).collect()}
    assert stats["README.md"].commit_count == 2 and stats["README.md"].last_modified_ts == datetime.datetime(2024, 1, 5, tzinfo=datetime.timezone.utc).timestamp()
    assert stats["src/pkg/main.py"].commit_count == 1 and "tests/test_main.py" not in stats
    text = repo_files.recent_changes(log, datetime.datetime(2024, 1, 3, tzinfo=datetime.timezone.utc).timestamp())
    assert "(2024-01-05) second" in text and "first" not in text and "- `README.md`" in text
    assert repo_files.recent_changes(log, 2e9) == ""


def test_recent_changes_have_every_commit_since_the_cutoff(spark, tree):
    log = spark.range(6000).selectExpr("lpad(cast(id as string), 8, '0') AS sha", "cast(id AS double) AS ts", "'f' AS path", "'s' AS subject")
    lines = repo_files.recent_changes(log, 10.0).split("\n")
    assert len([x for x in lines if x.endswith(") s")]) == 5990 and lines[2].startswith("- `00005999`") and lines[2 + 5989].startswith("- `00000010`")
    git(tree, "init", "-q")
    for day in (1, 2, 3, 4):
        git(tree, "commit", "-q", "--allow-empty", "-m", f"day {day}", date=f"2024-01-0{day}T00:00:00")
    assert {r.subject for r in repo_files.commits(spark, str(tree), limit=1).collect()} == {"day 4"}
    at = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc).timestamp()
    assert {r.subject for r in repo_files.commits(spark, str(tree), limit=1, since=at).collect()} == {"day 2", "day 3", "day 4"}
    assert {r.subject for r in repo_files.commits(spark, str(tree), limit=1, since=at + 0.5).collect()} == {"day 3", "day 4"}


def test_edges_of_a_tree(spark, tree):
    files = plan.scan(spark, [str(tree)], config.Config())
    got = {(r.src, r.dst, r.edge_type) for r in plan.dependencies(plan.parse(files), files).collect()}
    assert got >= {("src/pkg/main.py", "src/pkg/utils.py", "import"), ("src/pkg/main.py", "src/pkg/__init__.py", "import"), ("src/pkg/utils.py", "src/pkg/config.py", "import"), ("tests/test_main.py", "src/pkg/main.py", "import")}
    assert all(a != b for a, b, _ in got)


@pytest.mark.parametrize("budget", [100_000, 300, 40])
def test_whole_run(spark, tree, budget):
    settings = config.Config(token_budget=budget, no_git=True, layers=True)
    stages = plan.analyze(spark, [str(tree)], settings, as_of=1e9)
    first = plan.write(stages, str(tree), settings, as_of=1e9)
    rows = stages.included.collect()
    assert sum(r.charged for r in rows) <= budget
    if budget == 100_000:
        assert {r.path for r in rows} == KEPT and {r.tier for r in rows} == {1, 2, 3}
        assert next(r.tier for r in rows if r.path == "tests/test_main.py") == 3 == next(r.tier for r in rows if r.path == "pyproject.toml")
        again = plan.write(plan.analyze(spark, [str(tree)], settings, as_of=1e9), str(tree), settings, as_of=1e9)
        assert again == first and [f"## {k.upper()}" for k in config.SECTIONS] == [x for x in first.split("\n") if x.startswith("## ") and x[3:].replace("_", "").isupper()]
        assert (tree / "REPO_MAP.md").read_text() in first.replace("## CORE_MODULES", "") or (tree / "REPO_MAP.md").exists()


def test_json_run_with_a_query_and_a_provider(spark, tree):
    plan.PROVIDERS["upper"] = lambda settings: lambda path, text: f"SUMMARY of {path}"
    settings = config.Config(output_format="json", output_file="out.json", query="helper thing", task="architecture", llm_enabled=True, llm_provider="upper", no_git=True)
    stages = plan.analyze(spark, [str(tree)], settings, as_of=1e9, encode=cli.hashed_words)
    got = json.loads(plan.write(stages, str(tree), settings, as_of=1e9))
    assert got["stats"]["included_files"] == len(got["files"]) == len(KEPT)
    core = [f for f in got["files"] if f["tier"] == "CORE"]
    assert core and all(f["summary"] == f"SUMMARY of {f['path']}" for f in core if not f["path"].endswith(("main.py",)))


class Busy(http.server.BaseHTTPRequestHandler):
    """A service that is busy at first, and then says what it was asked."""

    seen: list[dict] = []

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
        Busy.seen.append(asked | {"key": self.headers.get("authorization")})
        busy = len(Busy.seen) < 3
        self.send_response(503 if busy else 400 if "refuse" in asked["messages"][0]["content"] else 200)
        self.end_headers()
        if not busy:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": " A summary. "}}]}).encode())

    def log_message(self, *args):
        pass


def test_providers(monkeypatch):
    server = http.server.HTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OPENAI_BASE_URL", f"http://127.0.0.1:{server.server_port}/")
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.setattr(time, "sleep", lambda s: None)
    settings = config.Config(llm_enabled=True, llm_provider="openai", llm_max_tokens=9)
    write = providers.summarizer(settings)
    assert write("a.py", "\n  first\nsecond") == "A summary."  # the third time
    assert len(Busy.seen) == 3 and Busy.seen[-1]["max_tokens"] == 9 and Busy.seen[-1]["key"] == "Bearer k" and "a.py" in Busy.seen[-1]["messages"][0]["content"]
    assert write("b.py", "refuse") == "b.py: refuse" and len(Busy.seen) == 4  # what is refused isn't tried again
    server.shutdown()
    server.server_close()
    assert write("c.py", "") == "c.py: empty file"
    with pytest.raises(providers.ProviderError):
        providers.PROVIDERS["openai"](settings)("c.py", "x")
    assert providers.summarizer(config.Config(llm_provider="none"))("d.py", "\n one\n") == "d.py: one"


def test_summaries_are_asked_for_together_and_stay_in_order(monkeypatch):
    lock, now, most = threading.Lock(), 0, 0

    def ask(path, text):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02 * (len(text) % 3))
        with lock:
            now -= 1
        return f"{path}:{text}"

    texts = ["x" * i for i in range(40)]
    assert providers.together(ask, [f"p{i}" for i in range(40)], texts) == [f"p{i}:{t}" for i, t in enumerate(texts)]
    assert most == providers.AT_ONCE and providers.together(ask, [], []) == []


def test_tokens_of_a_vocabulary(spark, tree):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "def f(x): return x\n" * 9, "<|endoftext|> né", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(bpe.count(path, F.col("t")).alias("n")).collect()] == [None if t is None else len(own.encode_ordinary(t)) for t in texts]
    cut = df.limit(2).where("t <> ''").select(bpe.truncated(path, F.col("t"), F.lit(3)).alias("c")).first().c
    assert cut == own.decode(own.encode_ordinary(texts[1])[:3]) + bpe.NOTE
    assert bpe.counter(public_tokenizers.path("word_bpe_49k.json"))("hello <|endoftext|>") > 2
    stages = plan.analyze(spark, [str(tree)], config.Config(no_git=True, token_budget=150, vocabulary=path), as_of=1e9)
    rows = stages.included.collect()
    assert sum(r.charged for r in rows) <= 150 and all(r.token_count == len(own.encode_ordinary(r.content)) for r in rows)


def test_search(spark, tree):
    best = plan.search(spark, [str(tree)], "helper Thing m", cli.hashed_words, 2).collect()
    assert best[0].path == "src/pkg/utils.py" and len(best) <= 2


def test_vectors_without_a_model():
    a, b, c = cli.hashed_words(["parseConfigFile reads settings", "parsing the config_file", "draw a circle"])
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    assert cos(a, b) > 0.3 > cos(a, c) and cli.hashed_words([""]) == [[0.0] * 512]


def test_vectors_are_kept(spark, tree, tmp_path):
    """Only what changed is embedded again; vectors of another length are made anew."""
    kept, log = f"file://{tmp_path}/kept", tmp_path / "log"

    def encode(texts, size=3):
        with open(log, "a") as f:
            f.write("x" * len(texts))
        return [[float(len(t)), 1.0, 2.0][:size] for t in texts]

    def made(how=encode):
        log.write_text("")
        assert plan.search(spark, [str(tree)], "q", how, kept=kept).count() > 0
        return len(log.read_text()) - 1  # the query itself

    assert made() == len(KEPT) and made() == 0
    (tree / "src/pkg/config.py").write_text("LIMIT = 4\n")
    (tree / "README.md").unlink()
    assert made() == 1 and spark.read.parquet(f"{kept}/vectors").count() == len(KEPT) - 1
    assert made(lambda texts: encode(texts, 2)) == len(KEPT) - 1


def test_parse_cache(spark, tree, tmp_path):
    kept = f"file://{tmp_path}/kept"
    files = plan.scan(spark, [str(tree)], config.Config())
    plan.parse(files, kept).count()
    (tree / "src/pkg/config.py").write_text("LIMIT = 4\nOTHER = 5\n")
    files = plan.scan(spark, [str(tree)], config.Config())
    schema = spark.read.parquet(kept).schema
    hits, missing = cache.split_by_cache(files, cache.read_table(spark, kept, schema))
    assert [r.path for r in missing.collect()] == ["src/pkg/config.py"] and hits.count() == len(KEPT) - 1
    got = {r.path: r.constants for r in plan.parse(files, kept).collect()}
    assert got["src/pkg/config.py"] == ["LIMIT = 4", "OTHER = 5"]
    assert cache.read_table(spark, f"{kept}-none", schema).count() == 0


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    path, schema = f"file://{tmp_path}/kept", spark.range(1).schema
    cache.replace_table(spark.range(3), path)
    assert cache.read_table(spark, path, schema).count() == 3
    # a run that died within its write: files, but no mark that they are all there
    spark.range(9).write.parquet(f"{path}/version=2")
    (tmp_path / "kept/version=2/_SUCCESS").unlink()
    assert cache.read_table(spark, path, schema).count() == 3
    cache.replace_table(cache.read_table(spark, path, schema).union(spark.range(3, 4)), path)
    assert cache.read_table(spark, path, schema).count() == 4
    assert [p.name for p in sorted((tmp_path / "kept").iterdir())] == ["version=3"]
    # one that died before it took the old one away
    spark.range(7).write.parquet(f"{path}/version=4")
    assert cache.read_table(spark, path, schema).count() == 7


def test_a_deep_tree_and_a_long_log_are_dealt_out(tmp_path, monkeypatch):
    for i in range(60):
        (tmp_path / f"src/p{i // 10}/q{i % 10}").mkdir(parents=True)
        (tmp_path / f"src/p{i // 10}/q{i % 10}/m.py").write_text(str(i))
    (tmp_path / "top.py").write_text("x")
    (tmp_path / "src/out").mkdir()
    (tmp_path / "src/out/no.py").write_text("x")
    monkeypatch.setattr(repo_files, "WIDE", 8)
    reader = repo_files._TreeReader({"path": str(tmp_path), "ignore": "out/"})
    parts = reader.partitions()
    assert len(parts) > 50 and all(len(p.entries) == 1 for p in parts)
    found = sorted(r[1] for p in parts for r in reader.read(p))
    assert found == sorted(["top.py", *(f"src/p{i // 10}/q{i % 10}/m.py" for i in range(60))])
    assert [p.entries for p in repo_files._TreeReader({"path": str(tmp_path / "none")}).partitions()] == [[]]

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for i in range(12):
        (tmp_path / "top.py").write_text(str(i))
        git("add", "top.py")
        git("commit", "-q", "-m", f"change {i}")
    git("checkout", "-q", "-b", "side", "HEAD~3")
    (tmp_path / "side.py").write_text("s")
    git("add", "side.py")
    git("commit", "-q", "-m", "aside")
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "merged", "side")

    def log(size, **options):
        monkeypatch.setattr(repo_files, "RANGE", size)
        r = repo_files._LogReader({"path": str(tmp_path)} | options)
        return len(r.partitions()), [x for p in r.partitions() for x in r.read(p)]

    n, whole = log(1000)
    some, dealt = log(5)
    assert (n, some) == (1, 3) and dealt == whole and len(whole) == 14
    assert ("side.py", "merged") in {(x[2], x[3]) for x in whole}  # what a merge brings, against its first parent
    assert len(log(5, limit="4")[1]) == 4 and log(5, since="4000000000")[1] == []


def test_manifest(spark, tree, tmp_path):
    one = plan.manifest_of(spark, [str(tree)], config.Config())
    cache.write_manifest(one, tmp_path / "m" / "manifest.json")
    old = cache.read_manifest(tmp_path / "m" / "manifest.json")
    assert cache.same_run(old, plan.manifest_of(spark, [str(tree)], config.Config()))
    (tree / "CONTEXT.md").write_text("the output itself")
    assert cache.same_run(old, plan.manifest_of(spark, [str(tree)], config.Config()))
    assert not cache.same_run(old, plan.manifest_of(spark, [str(tree)], config.Config(task="debug")))
    (tree / "src/pkg/config.py").write_text("x")
    assert not cache.same_run(old, plan.manifest_of(spark, [str(tree)], config.Config()))
    assert not cache.same_run(None, one) and not cache.same_run(one | {"version": "0"}, one)
    (tmp_path / "bad.json").write_text("{")
    assert cache.read_manifest(tmp_path / "bad.json") is None is cache.read_manifest(tmp_path / "none.json")


def test_differences(spark):
    old, new = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("b", "1"), ("c", "2"), ("d", "1")]))
    assert {tuple(r) for r in cache.differences(old, new).collect()} == {("a", "removed"), ("c", "changed"), ("d", "added")}
    assert {(r.path, r.sha256) for r in cache.upserted(old, new, "path").collect()} == {("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")}


def test_archives(tmp_path):
    (tmp_path / "c/d").mkdir(parents=True)
    (tmp_path / "c/d/f").write_text("12345")
    cache.export_archive(tmp_path / "c", tmp_path / "x.tgz")
    cache.import_archive(tmp_path / "x.tgz", tmp_path / "new")
    assert (tmp_path / "new/d/f").read_text() == "12345" and cache.folder_bytes(tmp_path / "new") == 5


# -- streams

AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def event(path, seconds, folder=False):
    return {"src_path": path, "is_directory": folder, "ts": (AT + datetime.timedelta(seconds=seconds)).isoformat()}


EVENTS = [event(f"src/{n}.py", i / 2) for i, n in enumerate("abcde")] + [event("src/a.py", 5.0), event("src", 5.5, True), event("", 6.0), event("x.lock", 20), event("src/z.py", 23.0), event("src/late.py", 100), event("README.md", 200)]


def test_batches_of_a_table(spark):
    rows = spark.createDataFrame([(e["src_path"], e["is_directory"], e["ts"]) for e in EVENTS], "src_path string, is_directory boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = debounce.batches(rows).orderBy("start").collect()
    assert [(r.events, r.paths) for r in got] == [(6, ["src/a.py", "src/b.py", "src/c.py", "src/d.py", "src/e.py"]), (2, ["src/z.py", "x.lock"]), (1, ["src/late.py"]), (1, ["README.md"])]
    assert [r.paths for r in debounce.relevant(debounce.batches(rows)).orderBy("start").collect()] == [["src/a.py", "src/b.py", "src/c.py", "src/d.py", "src/e.py"], ["src/z.py"], ["src/late.py"]]


@pytest.mark.parametrize("key", [None, "tree"])
def test_batches_of_a_hot_tree(spark, key):
    """One tree, or a null one, has nearly all events, most at the same places."""
    rng = random.Random(3)
    rows = [(rng.choice(["a.py", "b.py", f"c{i % 7}.py"]), False, rng.randrange(400) / 2, None if i % 10 else "t") for i in range(3000)]
    df = spark.createDataFrame(rows, "src_path string, is_directory boolean, s double, tree string").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for t in {r[3] if key else 0 for r in rows}:
        own, last = sorted((s, p) for p, _, s, k in rows if not key or k == t), None
        for s, p in own:
            if last is None or s - last > 0.5:
                want.append([t, s, 0, 0, set()])
            want[-1][2:4], last = [s + 0.5, want[-1][3] + 1], s
            want[-1][4].add(p)
    got = [(r.tree if key else 0, r.start.timestamp(), r.end.timestamp(), r.events, set(r.paths)) for r in debounce.batches(df, 0.5, key=key).collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)


def test_batches_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, EVENTS)))
    got = []

    def handle(paths):
        got.append(paths)
        raise ValueError("a failing handler ends its batch alone")

    debounce.watch(debounce.event_stream(spark, str(tmp_path / "in")), handle, str(tmp_path / "state"), once=True).awaitTermination(120)
    assert got[:2] == [["src/a.py", "src/b.py", "src/c.py", "src/d.py", "src/e.py"], ["src/z.py"]]


@pytest.mark.parametrize("key", [None, "tree"])
def test_a_streams_batches_are_the_tables_over_a_restart(spark, tmp_path, key):
    """Events out of order, in several files and two runs, with paths that come again: what has been quiet for
    long enough is there once, as in the table; the rest stays open."""
    rng = random.Random(8)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.choice((0.1, 0.5, 1.0, 2.999, 3.0, 3.001, 5.0, 9.0))
        rows.append({"src_path": f"src/{rng.choice('abc')}.py", "is_directory": False, "ts": (AT + datetime.timedelta(seconds=at)).isoformat(), "tree": rng.choice(["x", "y", None])})
    schema = debounce.EVENTS + ", tree string"
    want = debounce.batches(spark.read.schema(schema).json(spark.sparkContext.parallelize(map(json.dumps, rows))), key=key)
    told = lambda df: sorted(((r["tree"] if key else None, r.start, r.end, r.events, tuple(r.paths)) for r in df.collect()), key=repr)
    want = told(want)
    # each file's events are shuffled, and up to four seconds late against the file before
    late = sorted(range(len(rows)), key=lambda i: (datetime.datetime.fromisoformat(rows[i]["ts"]) + datetime.timedelta(seconds=rng.random() * 4)))
    (tmp_path / "in").mkdir()
    for run, part in enumerate((late[:150], late[150:])):
        for k in range(3):
            some = part[k * len(part) // 3 : (k + 1) * len(part) // 3]
            (tmp_path / f"in/{run}{k}.json").write_text("\n".join(json.dumps(rows[i]) for i in rng.sample(some, len(some))))
        debounce.write_batches(debounce.event_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "state"), key=key).awaitTermination(180)
    got = told(spark.read.parquet(str(tmp_path / "out")))
    end = max(datetime.datetime.fromisoformat(r["ts"]) for r in rows) - datetime.timedelta(seconds=10)
    closed = [w for w in want if w[2].timestamp() < end.timestamp()]
    assert got == closed and len(want) > len(closed) > 20
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_first_seen(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [event("a", 0) | {"sha256": "1"}, event("a", 1) | {"sha256": "1"}, event("a", 2) | {"sha256": "2"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = debounce.first_seen(debounce.event_stream(spark, str(tmp_path / "in"), debounce.EVENTS + ", sha256 string"))
    stream.writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.sha256 for r in spark.table("first_seen").collect()) == ["1", "2"]


def test_tree_changes(tree):
    reader = watcher._Changes({"path": str(tree)})
    start = reader.initialOffset()
    (tree / "src/pkg/new.py").write_text("x")
    (tree / "README.md").unlink()
    rows, end = reader.read(start)
    assert [r[0] for r in rows] == ["README.md", "src/pkg/new.py"]
    assert list(reader.read(end)[0]) == []


# -- commands


def test_commands(spark, tree, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path))
    assert cli.main(["analyze", str(tree), "--no-git", "--tokens", "500"]) == 0
    assert "shown in" in capsys.readouterr().out and (tree / "CONTEXT.md").exists()
    assert cli.main(["analyze", str(tree), "--no-git", "--tokens", "500"]) == 0
    assert "Up to date." in capsys.readouterr().out
    assert cli.main(["search", "helper", "--root", str(tree)]) == 0
    assert "src/pkg" in capsys.readouterr().out
    assert cli.main(["cache", "info", "--root", str(tree)]) == 0
    assert int(capsys.readouterr().out.split()[-2]) > 0
    parsed = lambda: spark.read.parquet(f"{cli.kept_folder(spark, str(tree))}/parsed").count()
    assert cli.main(["cache", "export", str(tmp_path / "c.tgz"), "--root", str(tree)]) == 0
    assert parsed() == len(KEPT) and cli.main(["cache", "clear", "--root", str(tree)]) == 0
    assert not cli.cache_dir(str(tree)).exists()
    capsys.readouterr()
    # packed and unpacked also where what is kept lies in a shared folder
    monkeypatch.setattr(cli, "kept_folder", lambda spark, root: f"file://{tmp_path}/shared/kept")
    assert cli.main(["cache", "import", str(tmp_path / "c.tgz"), "--root", str(tree)]) == 0
    assert parsed() == len(KEPT) and cli.main(["cache", "export", str(tmp_path / "d.tgz"), "--root", str(tree)]) == 0
    assert cli.main(["cache", "info", "--root", str(tree)]) == 0
    assert "last changed 2" in capsys.readouterr().out
    assert cli.main(["cache", "clear", "--root", str(tree)]) == 0 and not (tmp_path / "shared/kept").exists()
    assert cli.main(["analyze", str(tree), "--no-git", "--verbose", "--vocabulary", ""]) == 0
    assert "on cycles" in capsys.readouterr().out
    assert cli.main(["analyze", str(tree / "none")]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0


def test_benchmark(spark, tree):
    assert list(plan.benchmark(spark, [str(tree)], config.Config(no_git=True))) == ["walk", "parse", "graph", "rank", "compress"]


# -- the driver's contract


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
