"""Expressions over file paths: language, test files, stems, roles, skipped folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col

# Languages by file extension.
LANGUAGES = {
    "rs": "rust", "toml": "toml", "md": "markdown", "json": "json", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "py": "python", "go": "go", "swift": "swift", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "html": "html", "css": "css", "sql": "sql",
}
# Folders that are not scanned.
SKIPPED = [".git", ".agent-out", ".worktrees", "target", "node_modules", "vendor", "dist", "build", ".next", "out", "coverage"]


def file_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def directory(path: Column | str) -> Column:
    p = col(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def language(path: Column | str) -> Column:
    """Language by extension; null if there is none that is known."""
    ext = F.regexp_extract(file_name(path), r"[^.].*\.([^.]+)$|^[^.]+\.([^.]+)$", 1)
    ext = F.when(ext == "", F.regexp_extract(file_name(path), r"\.([^.]+)$", 1)).otherwise(ext)
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def normalised_path(path: Column | str) -> Column:
    return F.regexp_replace(F.translate(F.btrim(col(path)), "\\", "/"), r"^(\./)+", "")


def is_skipped(path: Column | str) -> Column:
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*map(F.lit, SKIPPED)))


def is_test(path: Column | str) -> Column:
    """Test folders, test affixes of the name, and camel-case suffixes that begin a word of the original name."""
    p = col(path)
    low, name = F.lower(p), F.lower(file_name(p))
    return (
        low.rlike(r"(^|/)(tests|test|__tests__|spec|specs)(/|$)")
        | name.rlike(r"^test_|_test\.go$|_test\.rs$|_tests\.rs$|\.test\.|\.spec\.|_spec\.rb$|_test\.py$")
        | file_name(p).rlike(r"\p{Ll}(Test|Tests|Spec|IT)\.(java|kt|kts|swift)$")
    )


def source_stem(path: Column | str) -> Column:
    """The name before its first dot without test affixes, lower case: equal for a source and its test."""
    stem = F.substring_index(file_name(path), ".", 1)
    stem = F.regexp_replace(stem, r"(?<=\p{Ll})(Tests|Test|Spec|IT)$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "^(test_)+", ""), "(_test)+$", ""), "(_tests)+$", ""), "(_spec)+$", ""))


def file_parts(path: Column) -> dict[str, Column]:
    """What ``file_fit`` looks at, to be computed once a file where a file meets many queries."""
    name = F.lower(file_name(path))
    return {"low_path": F.lower(path), "low_file": name, "file_stem": F.substring_index(name, ".", 1), "file_language": F.coalesce(language(path), F.lit("")), "is_test": is_test(path)}


def file_fit(parts: dict[str, Column], terms: Column) -> Column:
    """The score of ``file_score``, of parts that are there already."""
    low, name, stem, lang, test = (parts[c] for c in ("low_path", "low_file", "file_stem", "file_language", "is_test"))
    each = lambda t: F.when(stem == t, 8).when(F.contains(name, t), 4).when(F.contains(low, t), 2).otherwise(0) + F.when(lang == t, 3).otherwise(0)
    total = F.aggregate(terms, F.lit(0), lambda acc, t: acc + each(t))
    return F.when(test, F.floor(total / 2).cast("int")).otherwise(total)


def file_score(path: Column, terms: Column) -> Column:
    """Per term: stem 8, name 4 or path 2; language 3. Halved for test files."""
    return file_fit(file_parts(path), terms)


def relevance(lexical: Column, rank: Column, size: Column) -> Column:
    """Lexical evidence 20 a point, a bonus for the first 25 vector ranks, and 10 for files of up to 128 000 bytes."""
    return lexical * 20 + F.coalesce((25 - F.least(rank, F.lit(25))) * 3, F.lit(0)) + F.when(size <= 128_000, 10).otherwise(0)


# Endings of source files, names and endings of configuration files, languages of documents.
SOURCE_ENDINGS = [".rs", ".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".java", ".kt", ".kts", ".swift", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php"]
CONFIG_NAMES = ["cargo.toml", "cargo.lock", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", "dockerfile", "docker-compose.yml", "makefile"]
CONFIG_ENDINGS = [".toml", ".yaml", ".yml", ".lock"]
DOCUMENT_LANGUAGES = ["markdown", "text", "rst", "asciidoc"]


def _ends(c: Column, endings: list[str]) -> Column:
    return c.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def is_likely_source(path: Column | str) -> Column:
    """A source file by its ending, outside of test folders."""
    low = F.lower(col(path))
    return _ends(low, SOURCE_ENDINGS) & ~(F.startswith(low, F.lit("tests/")) | F.contains(low, F.lit("/tests/")) | F.contains(low, F.lit("__tests__")))


def role(path: Column | str, language_: Column | str) -> Column:
    """What a file is for; the first that fits."""
    low, lang = F.lower(col(path)), col(language_)
    name = file_name(low)
    return (
        F.when(low.rlike("^docs?/") | F.coalesce(lang.isin(*DOCUMENT_LANGUAGES), F.lit(False)), "documentation")
        .when(low.rlike("^tests?/|/tests?/|/__tests__/") | name.rlike(r"_test\.|\.test\.|_spec\.|\.spec\."), "test")
        .when(name.isin(*CONFIG_NAMES) | _ends(name, CONFIG_ENDINGS), "configuration")
        .when(lang.isNotNull(), "source")
        .otherwise("other")
    )


def location(path: Column, line_start: Column, line_end: Column) -> Column:
    """``path:start-end``, as much of it as there is; a place without a path is unknown."""
    start = F.concat(F.lit(":"), line_start.cast("string"))
    more = F.when(line_end > line_start, F.concat(F.lit("-"), line_end.cast("string"))).otherwise("")
    return F.when(path.isNull(), "unknown").otherwise(F.concat(path, F.when(line_start.isNull(), "").otherwise(F.concat(start, F.coalesce(more, F.lit(""))))))


def change_label(staged: Column, unstaged: Column) -> Column:
    """How a changed file stands in the index and in the worktree."""
    return (
        F.when(staged.isNull() & unstaged.isNull(), "changed")
        .when(staged == unstaged, staged)
        .when(unstaged.isNull(), F.concat(F.lit("staged "), staged))
        .when(staged.isNull(), F.concat(F.lit("unstaged "), unstaged))
        .otherwise(F.concat(F.lit("staged "), staged, F.lit(", unstaged "), unstaged))
    )


# What a status letter means.
CHANGES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "U": "unmerged", "?": "untracked", "!": "ignored"}


def change_name(letter: Column) -> Column:
    """The change a status letter stands for; null for a blank."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv]), F.nullif(letter, F.lit(" ")))


def unquote(path: str) -> str:
    """A path as git quotes it, with C escapes and octal bytes, read back."""
    if not (len(path) > 1 and path[0] == path[-1] == '"'):
        return path
    simple, out, i, body = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "\\": 92, '"': 34}, bytearray(), 0, path[1:-1]
    while i < len(body):
        if body[i] != "\\" or i + 1 == len(body):
            out += body[i].encode()
            i += 1
        elif body[i + 1 : i + 4].isdigit() and len(body[i + 1 : i + 4]) == 3 and max(body[i + 1 : i + 4]) < "8":
            out.append(int(body[i + 1 : i + 4], 8) & 255)
            i += 4
        else:
            out += bytes([simple[body[i + 1]]]) if body[i + 1] in simple else ("\\" + body[i + 1]).encode()
            i += 2
    return out.decode(errors="replace")
