"""Columns over file paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings by kind.
CODE_ENDINGS = (
    ".py .ts .tsx .js .jsx .mjs .ejs .ets .go .rs .java .groovy .gradle .cpp .cc .cxx .c .h .hpp .rb .swift .kt .kts .cs .scala .php .lua .luau .toc .zig "
    ".ps1 .ex .exs .m .mm .jl .vue .svelte .astro .dart .v .sv .svh .sql .r .f .f90 .f95 .f03 .f08 .pas .pp .dpr .dpk .lpr .inc .dfm .lfm .lpk .sh .bash "
    ".json .dm .dme .dmi .dmm .dmf .sln .csproj .fsproj .vbproj .razor .cshtml .yml .yaml"
).split()
DOCUMENT_ENDINGS = ".md .mdx .qmd .txt .rst".split()
IMAGE_ENDINGS = ".png .jpg .jpeg .gif .webp .svg .ico .bmp".split()
VIDEO_ENDINGS = ".mp4 .mp3 .mov .wav .webm .m4a .avi .mkv .flac .ogg .opus".split()
OFFICE_ENDINGS = ".docx .xlsx".split()
WORKSPACE_ENDINGS = ".gdoc .gsheet .gslides .gform".split()
# Folders and files that a scan passes over.
SKIPPED_FOLDERS = (
    "venv .venv env .env node_modules __pycache__ .git dist target out site-packages lib64 .pytest_cache .mypy_cache .ruff_cache .tox .eggs coverage "
    "lcov-report visual-tests visual-test __snapshots__ snapshots storybook-static dist-protected .next .nuxt .turbo .angular .idea .cache .parcel-cache "
    ".svelte-kit .terraform .serverless .worktrees worktrees"
).split()
SKIPPED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock Gemfile.lock composer.lock go.sum go.work.sum".split()
SENSITIVE_FOLDERS = ".ssh .gnupg .aws .gcloud secrets .secrets credentials".split()
SENSITIVE_NAMES = [
    r"^\.(env|envrc)(\.|$)",
    r"\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(^|[._-])(credential|secret|passwd|password|private_key)s?([._-]|$)",
    r"(?i)(^|[._-])tokens?([._-]|$)",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(\.netrc|\.pgpass|\.htpasswd)$",
    r"(?i)(aws_credentials|gcloud_credentials|service\.account)",
]
# Signs of a scientific paper; three of them make one.
PAPER_SIGNS = [
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{",
    r"\[\d+\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
]
PAPER_LEAST = 3
# Interpreters whose scripts are code.
INTERPRETERS = "python python3 python2 ruby perl node nodejs bash sh dash zsh fish ksh tcsh lua php julia Rscript".split()
# Language by ending, in order.
LANGUAGES = [
    ("Python", [".py"]), ("JavaScript", [".js", ".jsx"]), ("TypeScript", [".ts", ".tsx"]), ("Rust", [".rs"]), ("Go", [".go"]), ("Java", [".java"]),
    ("C", [".c", ".h"]), ("C++", [".cpp", ".hpp"]), ("Ruby", [".rb"]), ("PHP", [".php"]), ("Swift", [".swift"]), ("Kotlin", [".kt", ".kts"]),
]
# Parts and endings of paths of tests and examples.
TEST_PARTS = ["/test/", "/tests/", "/examples/", "/example/", "/spec/", "/fixtures/", "/fixture/"]
TEST_ENDINGS = ["_test.py", "_test.rs", "_test.go", "_test.js", "_test.ts", ".spec.ts", ".spec.js", ".test.ts", ".test.js"]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def ends_with(path: Column, endings: list[str]) -> Column:
    return _any([path.endswith(e) for e in endings])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ending(path: Column) -> Column:
    """The last ending with its dot, in small letters; empty without one; a leading dot makes none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))


def file_kind(path: Column, paper: Column | None = None) -> Column:
    """code, image, video, document, paper or null. paper: whether the content has enough signs of a paper."""
    e = ending(path)
    document = F.when(paper, "paper").otherwise("document") if paper is not None else F.lit("document")
    return (
        F.when(e.isin(CODE_ENDINGS), "code")
        .when(e == ".pdf", "paper")
        .when(e.isin(IMAGE_ENDINGS), "image")
        .when(e.isin(DOCUMENT_ENDINGS), document)
        .when(e.isin(OFFICE_ENDINGS + WORKSPACE_ENDINGS), "document")
        .when(e.isin(VIDEO_ENDINGS), "video")
    )


def paper_signs(text: Column) -> Column:
    """How many of the signs the first 3000 characters have."""
    head = F.substring(text, 1, 3000)
    out = F.lit(0)
    for sign in PAPER_SIGNS:
        out = out + head.rlike(sign).cast("int")
    return out


def is_sensitive(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    name = file_name(path)
    return F.arrays_overlap(folders, F.array(*map(F.lit, SENSITIVE_FOLDERS))) | _any([name.rlike(p) for p in SENSITIVE_NAMES])


def is_skipped(path: Column) -> Column:
    """Below a skipped folder, or a skipped file. target and out stay below src/main/java and src/test/java."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    noise = F.exists(
        folders, lambda f: (f.isin(SKIPPED_FOLDERS) & ~(f.isin("target", "out") & path.rlike(r"src/(main|test)/java/"))) | f.endswith("_venv") | f.endswith("_env") | f.endswith(".egg-info")
    )
    return noise | file_name(path).isin(SKIPPED_FILES)


def is_workspace_shortcut(path: Column) -> Column:
    return ending(path).isin(WORKSPACE_ENDINGS)


def shebang(content: Column) -> Column:
    """The interpreter that the first line names, env and its flags unwrapped; null without one."""
    line = F.regexp_extract(F.substring(content, 1, 256), r"^#!\s*([^\n]*)", 1)
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    first = file_name(F.try_element_at(words, F.lit(1)))
    rest = F.filter(F.slice(words, 2, 100), lambda w: ~w.startswith("-") & ~w.contains("="))
    return F.when(first == "env", file_name(F.try_element_at(rest, F.lit(1)))).otherwise(first)


def is_script(content: Column) -> Column:
    return F.coalesce(shebang(content).isin(INTERPRETERS), F.lit(False))


def language_by_ending(path: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, endings in LANGUAGES:
        out = out.when(ends_with(path, endings), name)
    return out.otherwise("Other")


def is_test_or_example(path: Column) -> Column:
    p = F.lower(path)
    return _any([p.contains(x) for x in TEST_PARTS]) | ends_with(p, TEST_ENDINGS) | (p.endswith(".java") & p.contains("test"))


def suffix_match(a: Column, b: Column) -> Column:
    """Equal, or one ends with a slash and the other."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^.*?://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"(/.*)$", 1), r"[?#].*$", "")


def url_kind(url: Column) -> Column:
    u, p = F.lower(url), F.lower(url_path(url))
    return (
        F.when(u.contains("twitter.com") | u.contains("x.com"), "tweet")
        .when(u.contains("arxiv.org"), "arxiv")
        .when(u.contains("github.com"), "github")
        .when(u.contains("youtube.com") | u.contains("youtu.be"), "youtube")
        .when(p.endswith(".pdf"), "pdf")
        .when(ends_with(p, [".png", ".jpg", ".jpeg", ".webp", ".gif"]), "image")
        .otherwise("webpage")
    )


def arxiv_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"(\d{4}\.\d{4,5})(v\d+)?", 1)
    return F.when(found != "", found)


def safe_file_name(url: Column, suffix: str = "") -> Column:
    clean = F.regexp_replace(F.regexp_replace(url, r"^.*?://", ""), r"[?#].*$", "")
    name = F.regexp_replace(F.regexp_replace(clean, r"(?U)[^\w\-]", "_"), r"^_+|_+$", "")
    return F.concat(F.substring(F.regexp_replace(name, r"_+", "_"), 1, 80), F.lit(suffix))


def is_public_url(url: Column) -> Column:
    """http or https with a host that is neither a metadata service nor a private or local address; no name is resolved."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    blocked = host.isin("metadata.google.internal", "metadata.google.com", "localhost", "[::1]")
    private = host.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    return url.rlike(r"(?i)^https?://") & (host != "") & ~blocked & ~private


def common_root(paths: Column) -> Column:
    """The longest common folder of an array of absolute paths, part by part."""
    low, high = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    pairs = F.zip_with(low, high, lambda a, b: a == b)
    n = F.coalesce(F.nullif(F.array_position(F.transform(pairs, lambda x: F.coalesce(x, F.lit(False))), False), F.lit(0)) - 1, F.size(low))
    return F.array_join(F.slice(low, 1, n.cast("int")), "/")
