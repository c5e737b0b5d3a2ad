"""Expressions on file paths, and the extension tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Extensions whose content is indexed.
TEXT_EXTENSIONS = [
    ".md", ".mdx", ".txt", ".rst",
    ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".mts", ".cts",
    ".html", ".css", ".scss", ".vue", ".svelte",
    ".py", ".pyi", ".go", ".rs",
    ".c", ".h", ".cpp", ".hpp", ".cc",
    ".java", ".kt", ".kts", ".rb", ".php",
    ".sh", ".bash", ".zsh", ".fish",
    ".json", ".yaml", ".yml", ".toml", ".xml",
    ".sql", ".lua", ".mbt", ".graphql", ".gql", ".astro",
]

# Language name and its extensions.
LANGUAGES = {
    "JavaScript": [".js", ".jsx", ".mjs", ".cjs"],
    "TypeScript": [".ts", ".tsx", ".mts", ".cts"],
    "Python": [".py", ".pyi"],
    "Go": [".go"],
    "Rust": [".rs"],
    "C": [".c", ".h"],
    "C++": [".cpp", ".hpp", ".cc"],
    "Java": [".java"],
    "Kotlin": [".kt", ".kts"],
    "Ruby": [".rb"],
    "PHP": [".php"],
    "Shell": [".sh", ".bash", ".zsh", ".fish"],
    "HTML": [".html"],
    "CSS": [".css"],
    "SCSS": [".scss"],
    "JSON": [".json"],
    "YAML": [".yaml", ".yml"],
    "TOML": [".toml"],
    "XML": [".xml"],
    "SQL": [".sql"],
    "Markdown": [".md", ".mdx"],
    "Lua": [".lua"],
    "MoonBit": [".mbt"],
    "Vue": [".vue"],
    "Svelte": [".svelte"],
    "Astro": [".astro"],
    "GraphQL": [".graphql", ".gql"],
}

# Fixed value: the largest file that is cut into chunks, in bytes.
MAX_TEXT_BYTES = 512 * 1024


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; NULL without one."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)), F.lit(""))


def dotted(ext: str) -> str:
    return ext if ext.startswith(".") else f".{ext}"


def language(ext: Column) -> Column:
    """Language of an extension; NULL for the others."""
    pairs = [F.lit(item) for name, exts in LANGUAGES.items() for e in exts for item in (e, name)]
    return F.try_element_at(F.create_map(*pairs), F.lower(ext))


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`; other paths stay as they are."""
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/+", "")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_millis(ts) / F.lit(1000.0)
