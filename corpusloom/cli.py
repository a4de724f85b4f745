"""Commands: analyze, benchmark, watch, search, cache export/import/clear/info."""

from __future__ import annotations

import argparse
import hashlib
import re
import shutil
import sys
import time
import uuid
from pathlib import Path

from . import config

VERSION = "0.1.0"


def session(name: str = "corpusloom"):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def cache_dir(root: str) -> Path:
    return Path.home() / ".cache" / "corpusloom" / hashlib.sha256(str(Path(root).resolve()).encode()).hexdigest()[:16]


def kept_folder(spark, root: str) -> str:
    """Where parsed files and vectors are kept: executors write there, so in the shared folder where one
    is named."""
    from .storage import shared_root

    place, named = cache_dir(root), shared_root(spark)
    return f"{named}/corpusloom-kept/{place.name}" if named else f"file://{place}/tables"


def hashed_words(texts: list[str], size: int = 512) -> list[list[float]]:
    """Vectors without a model, where no encoder is given: the words of a text, names cut at capitals and
    underscores, and the three-letter pieces of longer ones, so that forms of a word are near each
    other; by signed hashes, often used ones with less weight."""
    out = []
    for t in texts:
        counts: dict[str, float] = {}
        for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", t):
            w = w.lower()
            counts[w] = counts.get(w, 0) + 1
            for i in range(len(w) - 2 if len(w) > 3 else 0):
                counts[f"~{w[i : i + 3]}"] = counts.get(f"~{w[i : i + 3]}", 0) + 1 / len(w)
        v = [0.0] * size
        for w, n in counts.items():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % size] += (1.0 if h >> 63 else -1.0) * n**0.5
        out.append(v)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("--version", action="version", version=f"corpusloom {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)

    def run(name: str) -> argparse.ArgumentParser:
        a = sub.add_parser(name)
        a.add_argument("root")
        for flag, kind in (("tokens", int), ("output", str), ("since", str), ("query", str), ("task", str), ("format", str), ("vocabulary", str), ("llm-provider", str), ("llm-model", str), ("llm-max-tokens", int)):
            a.add_argument(f"--{flag}", type=kind)
        for flag in ("exclude", "extra-root"):
            a.add_argument(f"--{flag}", action="append")
        for flag in ("verbose", "no-git", "layers", "llm", "force", "include-sensitive"):
            a.add_argument(f"--{flag}", action="store_true", default=None)
        return a

    run("analyze")
    run("benchmark")
    run("watch").add_argument("--debounce", type=float)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--root", default=".")
    s.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("cache").add_subparsers(dest="action", required=True)
    for action in ("export", "import"):
        a = c.add_parser(action)
        a.add_argument("archive")
        a.add_argument("--root", default=".")
    for action in ("clear", "info"):
        c.add_parser(action).add_argument("--root", default=".")
    return p


def settings_of(args: argparse.Namespace) -> config.Config:
    return config.load_config(
        args.root, token_budget=args.tokens, output_file=args.output, since=args.since, query=args.query, task=args.task, output_format=args.format, verbose=args.verbose, no_git=args.no_git, layers=args.layers, force=args.force,
        extra_ignore=args.exclude, extra_roots=args.extra_root, include_sensitive=args.include_sensitive, llm_enabled=args.llm, llm_provider=args.llm_provider, llm_model=args.llm_model, llm_max_tokens=args.llm_max_tokens, vocabulary=args.vocabulary, debounce=getattr(args, "debounce", None),
    )


def analyze(spark, root: str, settings: config.Config) -> str:
    """Run unless nothing has changed since the last run; returns what to say."""
    from .plans import analyze as plan
    from .sources import cache

    roots = [root, *settings.extra_roots]
    place = cache_dir(root)
    new = plan.manifest_of(spark, roots, settings)
    if not settings.force and Path(root, settings.output_file).is_file() and cache.same_run(cache.read_manifest(place / "manifest.json"), new):
        return "Up to date."
    place.mkdir(parents=True, exist_ok=True)
    stages = plan.analyze(spark, roots, settings, encode=hashed_words, kept=kept_folder(spark, root))
    text = plan.write(stages, root, settings)
    cache.write_manifest(new, place / "manifest.json")
    from pyspark.sql import functions as F

    from .functions import text as tx
    from .functions import tokens as bpe
    from .operators import extract, graph, report

    count = (lambda c: bpe.count(settings.vocabulary, c)) if settings.vocabulary else tx.estimated_tokens
    n = report.savings(stages.files.select(count(F.col("text")).alias("tokens")), stages.included).first()
    lines = [
        f"{n['files']} files, {n['tokens']} tokens; {n['shown']} shown in {n['shown_tokens']} tokens" + (f", {n['saved']} % less" if n["tokens"] else "") + f": {settings.output_file} ({len(text)} letters)",
    ]
    if settings.verbose:
        counted, health = graph.counts(stages.parsed, stages.edges).first(), extract.health(stages.parsed).orderBy("language").collect()
        lines += [f"  graph    {counted['nodes']} files, {counted['edges']} edges, {stages.cyclic.count()} on cycles", f"  budget   {n['shown_tokens']} of {settings.token_budget} tokens"]
        lines += [f"  parsed   {r['language']}: {r['success']} of {r['total']}" for r in health]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .sources import cache

    if args.command == "cache":
        spark, place = session(), cache_dir(args.root)
        kept, tables = kept_folder(spark, args.root), place / "tables"
        elsewhere = kept != f"file://{tables}"
        if args.action == "export":
            if elsewhere:
                cache.fetch(spark, kept, tables)
            cache.export_archive(place, args.archive)
        elif args.action == "import":
            cache.import_archive(args.archive, place)
            if elsewhere:
                cache.put(spark, tables, kept)
        elif args.action == "clear":
            shutil.rmtree(place, ignore_errors=True)
            cache.drop(spark, kept)
        at = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(place.stat().st_mtime)) if place.exists() else "never"
        size = (cache.folder_bytes(place) if place.exists() else 0) + (cache.kept_bytes(spark, kept) if elsewhere else 0)
        print(f"{place}, last changed {at}: {size} bytes")
        return 0
    if not Path(args.root).is_dir():
        print(f"no such folder: {args.root}", file=sys.stderr)
        return 1
    spark = session()
    if args.command == "search":
        from .plans import analyze as plan

        for r in plan.search(spark, [args.root], args.query, hashed_words, args.limit, kept=kept_folder(spark, args.root)).collect():
            print(f"{r['relevance']:.3f}  {r['path']}")
        return 0
    settings = settings_of(args)
    if args.command == "analyze":
        print(analyze(spark, args.root, settings))
    elif args.command == "benchmark":
        from .plans import analyze as plan

        for name, seconds in plan.benchmark(spark, [args.root, *settings.extra_roots], settings).items():
            print(f"{name:10} {seconds:8.2f} s")
    else:
        from .storage import shared_dir
        from .streaming import debounce, watcher

        print(analyze(spark, args.root, settings))
        watcher.register(spark)
        events = spark.readStream.format("tree_changes").option("path", args.root).load()
        state = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
        debounce.watch(events, lambda changed: print(len(changed), "changed:", analyze(spark, args.root, settings)), state, settings.debounce).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
