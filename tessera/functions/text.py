"""Expressions over text: tokens, scores, normal forms, redaction. All built-in, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and opposing words of fact comparison.
STOP_TERMS = "are but can for had has have now not should that the then this was were when will with".split()
SIGNALS = [
    ("after", "before", "after_vs_before"),
    ("allow", "deny", "allow_vs_deny"),
    ("allowed", "denied", "allowed_vs_denied"),
    ("enabled", "disabled", "enabled_vs_disabled"),
    ("enable", "disable", "enable_vs_disable"),
    ("present", "absent", "present_vs_absent"),
    ("true", "false", "true_vs_false"),
]
SIGNAL_TERMS = [w for a, b, _ in SIGNALS for w in (a, b)]

# What is redacted, in this order (pattern, replacement).
REDACTIONS = [
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"(?i)\b(authorization\s*:\s*(?:bearer|basic|token)\s+)\S+", "$1[REDACTED]"),
    (r"""(?i)\b([A-Z0-9_.-]*(?:api[_.-]?key|secret|token|passwd|password|credential)[A-Z0-9_.-]*\s*[=:]\s*)("[^"]{4,}"|'[^']{4,}'|[^\s"']{4,})""", "$1[REDACTED]"),
    (r"(?i)(--?[A-Za-z0-9_-]*(?:api[_-]?key|secret|token|password)[A-Za-z0-9_-]*\s+)[^\s-][^\s]{3,}", "$1[REDACTED]"),
    (r"(?i)(\blogin\b[^\n]*?\s-p\s+)([^\s][^\s]*)", "$1[REDACTED]"),
    (r"(?i)(\s-p)([^\s-][^\s]{2,})", "$1[REDACTED]"),
    (r"(://[^/\s:@]+):([^@/\s]+)@", "$1:[REDACTED]@"),
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b", "[REDACTED]"),
]

# Letters with the vowel signs that some scripts write beside them.
WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}_-]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits, ``_`` and ``-``, in order, repeats kept. Null text: no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), WORD_BREAK), lambda t: t != "")


def joined_tokens(text: Column | str) -> Column:
    """The tokens of ``tokens`` with one blank between them."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), WORD_BREAK, " "), F.lit(" "))


def token_count(text: Column | str) -> Column:
    """How many tokens a text has, without making them: its runs of word characters."""
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(r"[\p{IsAlphabetic}\p{N}_-]+"))


def selective_terms(text: Column | str) -> Column:
    """Tokens of more than two bytes."""
    return selective(tokens(text))


def selective(tokens: Column | str) -> Column:
    """Those of more than two bytes, of tokens that are there already."""
    return F.filter(col(tokens), lambda t: F.octet_length(t) > 2)


def query_terms(text: Column | str) -> Column:
    """Selective terms; all tokens where none is selective, so that a short query still searches."""
    some = selective_terms(text)
    return F.when(F.size(some) > 0, some).otherwise(tokens(text))


def contained(terms: Column, text: Column) -> Column:
    """How many of the terms (repeats counted) occur in a text as substrings."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def recall_score(text: Column | str, terms: Column, query: Column) -> Column:
    """10 if the whole query occurs in the text, and 1 for each term that does; case folded."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(F.contains(low, F.lower(query)), 10).otherwise(0) + contained(terms, low)


def normalised(text: Column | str) -> Column:
    """White space collapsed, case folded: texts that are equal so are duplicates."""
    return F.lower(F.regexp_replace(F.btrim(col(text), F.lit(" \t\n\r\x0b\x0c")), r"[ \t\n\x0B\f\r]+", " "))


def meaningful_terms(text: Column | str) -> Column:
    """Distinct query terms that are neither stop words nor signal words."""
    return F.array_except(F.array_distinct(query_terms(text)), F.array(*map(F.lit, STOP_TERMS + SIGNAL_TERMS)))


# What a text must hold for any of the patterns to match: a cheap test that most texts fail.
SUSPECT = r"(?i)-----BEGIN|authorization|api[_.-]?key|secret|token|passw|credential|\blogin\b|\s-p[^\s-]|://[^/\s:@]+:|\bsk-|\bgh[pousr]_|\bxox[baprs]-|AKIA|\beyJ"


def redact(text: Column | str) -> Column:
    """Secrets replaced by signs. Texts without any sign of one are not searched pattern by pattern."""
    out = col(text)
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(F.rlike(col(text), F.lit(SUSPECT)), out).otherwise(col(text))


def token_estimate(text: Column | str) -> Column:
    """Tokens that a text is thought to cost: its words or a quarter of its characters, whichever is more, 1 at least."""
    t = F.coalesce(col(text), F.lit(""))
    n_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.greatest(n_words, F.ceil(F.length(t) / 4).cast("int"), F.lit(1))


def identifier_words(name: Column | str) -> Column:
    """Words of an identifier: split at all but letters and digits, at camel humps and after acronyms; two bytes or more, lower case."""
    parts = F.split(col(name), r"[^\p{L}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
    return F.filter(F.transform(parts, lambda w: F.lower(w)), lambda w: F.octet_length(w) >= 2)


def light_stem_match(word: Column, term: Column) -> Column:
    """Equal, or one a prefix of the other: the shorter of four or more, the longer by at most three."""
    short, long_ = F.least(F.octet_length(word), F.octet_length(term)), F.greatest(F.octet_length(word), F.octet_length(term))
    return (word == term) | ((F.startswith(word, term) | F.startswith(term, word)) & (short >= 4) & (long_ - short <= 3))


def snippet(text: Column | str, n: int = 140) -> Column:
    t = F.btrim(col(text))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def list_summary(items: Column, n: int) -> Column:
    """The first n joined by commas, and how many more there are."""
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def commit_task(subject: Column | str) -> Column:
    """``type(scope): text`` -> ``scope text``; ``type: text`` -> ``text``; else the subject itself."""
    s = F.btrim(col(subject))
    scope, rest = F.regexp_extract(s, r"^[a-zA-Z]+\(([^)]*)\)!?:\s*(.*)$", 1), F.regexp_extract(s, r"^[a-zA-Z]+(?:\([^)]*\))?!?:\s*(.*)$", 1)
    return F.when(rest == "", s).when(scope == "", rest).otherwise(F.concat_ws(" ", scope, rest))


def wildcard_regex(pattern: str) -> str:
    """A file pattern (``*`` any run, ``/`` included, ``?`` one character) as a regular expression of the whole text."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def symbol_prefilter(name: Column, path: Column, kind: Column, signature: Column, terms: Column) -> Column:
    """Whether a symbol can score at all: a cheap test that is wider than the score. Word matches of a term begin with its
    first four letters."""
    n, p, k, s = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, path, kind, signature))
    return F.exists(terms, lambda t: F.contains(n, F.substring(t, 1, 4)) | F.contains(p, t) | F.contains(s, t) | (k == t))


def symbol_parts(name: Column, path: Column, kind: Column, signature: Column) -> dict[str, Column]:
    """What ``symbol_fit`` looks at, to be computed once a symbol where a symbol meets many queries."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return {"low_name": low(name), "low_path": low(path), "low_kind": low(kind), "low_signature": low(signature), "name_words": identifier_words(name)}


def symbol_fit(parts: dict[str, Column], terms: Column, query: Column) -> Column:
    """The score of ``symbol_score``, of parts that are there already."""
    n, p, k, s, words = (parts[c] for c in ("low_name", "low_path", "low_kind", "low_signature", "name_words"))
    q = F.lower(F.coalesce(query, F.lit("")))
    each = lambda t: (
        F.when(n == t, 10).when(F.array_contains(words, t), 7).when(F.exists(words, lambda w: light_stem_match(w, t)), 6).when(F.contains(n, t), 5).otherwise(0)
        + F.when(k == t, 3).otherwise(0)
        + F.when(F.contains(p, t), 2).otherwise(0)
        + F.when(F.contains(s, t), 1).otherwise(0)
    )
    by_terms = F.aggregate(terms, F.lit(0), lambda acc, t: acc + each(t))
    bonus = F.when(k.isin("function", "method"), 2).when(k.isin("struct", "class", "trait", "interface", "enum", "impl", "protocol", "object", "record", "actor", "type"), 1).otherwise(0)
    return F.when((n == q) | F.contains(s, q), 12).otherwise(0) + by_terms + F.when(by_terms > 0, bonus).otherwise(0)


def symbol_score(name: Column, path: Column, kind: Column, signature: Column, terms: Column, query: Column) -> Column:
    """How well a code symbol fits: exact name or signature, then name tiers, kind, path and signature per term."""
    return symbol_fit(symbol_parts(name, path, kind, signature), terms, query)


def tokens_of(text: Column | str) -> Column:
    """The estimate of a field of a pack: none for one that is missing or empty."""
    t = col(text)
    return F.when(t.isNull() | (t == ""), 0).otherwise(token_estimate(t))


def tail(text: Column | str, n: int = 300) -> Column:
    """The last characters of an output, white space at its ends cut."""
    return F.right(F.btrim(col(text), F.lit(" \t\n\r\x0b\x0c")), F.lit(n))


def fts_query(terms: Column) -> Column:
    """Terms as a full-text query: quoted, quotes doubled, any of them."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def is_exported(signature: Column | str, language: Column | str, name: Column | str) -> Column:
    """A symbol that other files may use: by the first word of its signature, or in Go by its capital."""
    first = F.substring(col(name), 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.lower(F.ltrim(col(signature))).rlike(r"^(pub |pub\(|public |open |export[ \t])") | F.coalesce((col(language) == "go") & capital, F.lit(False))


def is_entrypoint(name: Column | str) -> Column:
    """A function that nobody needs to call by name."""
    low = F.lower(col(name))
    return low.isin("main", "init", "new", "default") | F.startswith(low, F.lit("test_")) | F.endswith(low, F.lit("_test"))
