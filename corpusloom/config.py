"""Fixed values of the engine's semantics, task profiles, and settings of a run."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

# -- fixed values: results depend on them ----------------------------------------------------------

#: Patterns that are ignored before any ignore file is read.
ALWAYS_IGNORE = (
    ".git/",
    ".github/",
    ".idea/",
    ".vscode/",
    ".venv/",
    "__pycache__/",
    "*.pyc",
    "*.log",
    "*.lock",
    "*.sqlite",
    "*.db",
    "*.cache",
    ".corpusloom_cache/",
    ".mypy_cache/",
    ".pytest_cache/",
    "node_modules/",
    "dist/",
    "build/",
    "coverage/",
    ".ruff_cache/",
    ".env",
    ".env.*",
    "LICENSE",
    "LICENCE",
    "assets/",
    "go.sum",
)

#: Names of files that a reader starts from.
ENTRY_NAMES = (
    "main.py",
    "__main__.py",
    "app.py",
    "cli.py",
    "manage.py",
    "index.ts",
    "index.js",
    "index.tsx",
    "index.jsx",
    "server.ts",
    "server.js",
    "main.go",
    "main.rs",
    "lib.rs",
    "Main.java",
    "Application.java",
    "main.c",
    "main.cc",
    "main.cpp",
    "main.cxx",
    "Rakefile",
    "config.ru",
)

#: Patterns of files that may hold secrets.
SENSITIVE = (".env", ".env.*", "*.pem", "*.key", "*.crt", "*.p12", "*.pfx", "id_rsa", "id_ed25519", "credentials.json", "service-account*.json", "*.secret", "secrets.yaml", "secrets.yml")

#: Folders that hold no source, and names and suffixes of configuration and source files.
NON_SOURCE_DIRS = ("tests", "test", "docs", "doc", "examples", "example", "benchmarks", "benchmark", "scripts", "script")
CONFIG_NAMES = (
    "pyproject.toml",
    "setup.cfg",
    "setup.py",
    "package.json",
    "package-lock.json",
    "yarn.lock",
    "Cargo.toml",
    "Cargo.lock",
    "go.mod",
    "go.sum",
    "requirements.txt",
    "requirements-dev.txt",
    "Makefile",
    "Dockerfile",
    ".dockerignore",
    "tsconfig.json",
    "jest.config.js",
    "jest.config.ts",
    ".eslintrc",
    ".eslintrc.json",
    ".eslintrc.js",
    ".prettierrc",
    "babel.config.js",
    "vite.config.ts",
    "webpack.config.js",
)
CONFIG_SUFFIXES = (".toml", ".cfg", ".ini", ".env", ".yaml", ".yml", ".json")

#: Suffixes of each language's files.
LANGUAGES = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh"),
    "ruby": (".rb",),
}

#: What a watcher takes notice of and what it doesn't.
WATCH_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".go", ".rs", ".java", ".cpp", ".c", ".h", ".rb", ".php")
WATCH_IGNORED_DIRS = ("__pycache__", ".git", "node_modules", "dist", "build")
WATCH_IGNORED_NAMES = ("package-lock.json", "yarn.lock", "uv.lock")
WATCH_IGNORED_GLOBS = ("*.pyc", "*.pyo", "*.lock")

#: Folders that the dependency diagram leaves out.
DIAGRAM_IGNORED_DIRS = ("tests", "test", "docs", "doc", "config", "configs", "queries", "build", "dist")

#: Sections of the document, in order.
SECTIONS = ("architecture", "entry_points", "symbol_index", "important_call_paths", "core_modules", "supporting_modules", "dependency_graph", "ranked_files", "periphery")
MAP_SECTIONS = ("architecture", "entry_points", "symbol_index", "important_call_paths", "dependency_graph", "ranked_files")
CORE_SECTIONS = ("core_modules", "supporting_modules")
#: Files of the layers, by name, and their sections.
LAYERS = {"REPO_MAP.md": MAP_SECTIONS, "CORE_CONTEXT.md": CORE_SECTIONS}
TIER_NAMES = {1: "CORE", 2: "SUPPORTING", 3: "PERIPHERAL"}

#: Limits.
TOKEN_BUDGET = 120_000
CYCLE_PENALTY = 0.10
SEMANTIC_WEIGHT = 0.20
DIAGRAM_NODES = 25
ENTRY_LINES = 300
BINARY_PROBE = 8192
COMMITS = 5000
AGE_DAYS = 365.0
SUMMARY_TOKENS = 200
INDEX_SYMBOLS = 150
RANKED_ROWS = 40
RECENT_FILES = 50
DEBOUNCE_SECONDS = 3.0

#: Weights of the signals by task, before they are made to sum to one.
SIGNALS = ("freq", "fan_in", "recency", "proximity", "symbols", "depth")
PROFILES = {
    "default": (0.40, 0.40, 0.10, 0.10, 0.0, 0.0),
    "debug": (0.20, 0.20, 0.50, 0.10, 0.0, 0.0),
    "feature": (0.20, 0.50, 0.10, 0.10, 0.10, 0.0),
    "architecture": (0.10, 0.60, 0.05, 0.15, 0.0, 0.10),
    "refactor": (0.10, 0.50, 0.05, 0.10, 0.25, 0.0),
}


def weights(task: str = "default", semantic: bool = False) -> dict[str, float]:
    """Weight of each signal: the task's profile (an unknown task has the default's), summing to one,
    or to what a semantic score leaves."""
    own = PROFILES.get(task, PROFILES["default"])
    total = sum(own)
    scale = 1.0 - SEMANTIC_WEIGHT if semantic else 1.0
    return {k: w / total * scale for k, w in zip(SIGNALS, own, strict=True)}


# -- settings of a run ------------------------------------------------------------------------------

SETTINGS_FILE, SETTINGS_TABLE = ".corpusloom.toml", "corpusloom"


@dataclass(frozen=True)
class Config:
    token_budget: int = TOKEN_BUDGET
    output_file: str = "CONTEXT.md"
    since: str | None = None
    verbose: bool = False
    no_git: bool = False
    query: str = ""
    task: str = "default"
    layers: bool = False
    output_format: str = "markdown"
    debounce: float = DEBOUNCE_SECONDS
    extra_ignore: tuple[str, ...] = ()
    extra_roots: tuple[str, ...] = ()
    include_sensitive: bool = False
    llm_enabled: bool = False
    llm_provider: str = ""
    llm_model: str = ""
    llm_max_tokens: int = 256
    force: bool = False
    #: A vocabulary file that tokens are counted by; estimated where there is none.
    vocabulary: str = ""


def load_config(root: str | Path, **given: Any) -> Config:
    """Settings: what is ``given`` and not None, else the settings file of ``root``, else the table of
    its pyproject.toml, else the defaults. A file may have its keys on top or in a table."""
    root, found = Path(root), {}
    own, project = root / SETTINGS_FILE, root / "pyproject.toml"
    if own.is_file():
        found = tomllib.loads(own.read_text(encoding="utf-8"))
        found = found.get(SETTINGS_TABLE, found)
    elif project.is_file():
        found = tomllib.loads(project.read_text(encoding="utf-8")).get("tool", {}).get(SETTINGS_TABLE, {})
    kinds = {f.name: type(f.default) for f in fields(Config)}
    values: dict[str, Any] = {}
    for source in (found, {k: v for k, v in given.items() if v is not None}):
        for k, v in source.items():
            if k in kinds:
                values[k] = tuple(v) if kinds[k] is tuple else v if v is None or kinds[k] is type(None) else kinds[k](v)
    return replace(Config(), **values)
