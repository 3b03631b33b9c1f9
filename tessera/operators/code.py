"""Code extraction over lines of text: declarations by line, references, kinds of references, body metrics.

Lines are rows; everything is built-in expressions, an equi-join of identifier tokens with names, and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import col
from tessera.sources.scratch import keep

# Modifiers before a declaration, and keywords with the kind of symbol they declare, by language.
MODIFIERS = (
    "pub async unsafe const export default public private protected static final abstract open override data sealed inner value inline infix operator suspend tailrec external lateinit"
).split()
RUST = [("fn", "function"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("mod", "module"), ("type", "type"), ("const", "constant"), ("static", "static")]
PYTHON = [("def", "function"), ("class", "class")]
SCRIPT = [("function", "function"), ("class", "class"), ("interface", "interface"), ("type", "type"), ("enum", "enum")]
C_FAMILY = [
    ("func", "function"), ("fun", "function"), ("function", "function"), ("class", "class"), ("struct", "struct"), ("enum", "enum"),
    ("interface", "interface"), ("protocol", "protocol"), ("object", "object"), ("record", "record"),
]
BY_LANGUAGE = {"rust": RUST, "python": PYTHON, "javascript": SCRIPT, "typescript": SCRIPT, "java": C_FAMILY, "kotlin": C_FAMILY, "swift": C_FAMILY, "c": C_FAMILY, "cpp": C_FAMILY}
# Further declarations, (languages, pattern of the whole line with the name as its group, kind), the first that fits.
_J = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)"
_M = r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*"
MORE = [
    (["rust"], r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[^{]*\bfor\s+)?&?([A-Za-z_][A-Za-z0-9_]*)", "impl"),
    (["javascript", "typescript"], r"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>|function\b)", "function"),
    (["javascript"], r"^\s*(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=", "function"),
    (["javascript", "typescript"], r"^\s+" + _M + r"(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b)([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;]+)?\{\s*$", "function"),
    (["java"], r"^\s*" + _J + r"*@interface\s+([A-Za-z_]\w*)", "annotation"),
    (["java"], r"^\s+" + _J + r"*(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)[A-Za-z_][\w<>\[\],.? ]*\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?\{?\s*$", "function"),
    (["kotlin"], r"^\s*(?:\w+\s+)*annotation\s+class\s+([A-Za-z_]\w*)", "annotation"),
    (["kotlin"], r"^\s*(?:\w+\s+)*enum\s+class\s+([A-Za-z_]\w*)", "enum"),
    (["kotlin", "swift"], r"^\s*(?:\w+\s+)*typealias\s+([A-Za-z_]\w*)", "type"),
    (["kotlin"], r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:[A-Z]\w*(?:<[^>]*>)?\.)([A-Za-z_]\w*)\s*\(", "function"),
    (["swift"], r"^\s*(?:\w+\s+)*actor\s+([A-Za-z_]\w*)", "actor"),
    (["swift"], r"^\s*(?:\w+\s+)*extension\s+([A-Za-z_]\w*)", "extension"),
]
TYPE_LIKE = "struct enum trait type class interface protocol object record actor impl annotation extension".split()
BRANCHES = "if elif for while match case catch except switch when guard".split()


def lines(files: DataFrame) -> DataFrame:
    """(path, language, n_lines, line, text) of (path, language, text); lines count from 1."""
    parts = F.split("text", "\n")
    return files.select("path", "language", F.size(parts).alias("n_lines"), F.posexplode(parts).alias("i", "text")).select("path", "language", "n_lines", (F.col("i") + 1).cast("long").alias("line"), "text")


def declarations(files: DataFrame) -> DataFrame:
    """(path, name, kind, line_start, line_end, signature): a symbol ends before the next one, the last with the file."""
    rows = lines(files).where(~F.col("text").rlike(r"^\s*(//|#|/\*|\*|$)"))
    rest = F.regexp_replace(F.btrim("text"), rf"^((pub(\([^)]*\))?|{'|'.join(MODIFIERS)})\s+)+(?=\S)", "")
    # one pattern for all languages; whether a keyword declares anything in this one, and what, is looked up
    keywords = sorted({k for ks in BY_LANGUAGE.values() for k, _ in ks} - {"const", "static"}, key=len, reverse=True)
    pattern = rf"^({'|'.join(keywords)})\s+([A-Za-z_$][A-Za-z0-9_$]*)"
    fixed = r"^(?:pub(?:\([^)]*\))?\s+)?(const|static)\s+(?!fn\b|unsafe\b|async\b)(?:mut\s+)?([A-Za-z_$][A-Za-z0-9_$]*)"  # their own keyword is a modifier too
    kinds = F.create_map(*[F.lit(x) for lang, ks in BY_LANGUAGE.items() for k, kind in ks for x in (f"{lang} {k}", kind)])
    rows = rows.withColumn("rest", rest)
    word, constant = F.regexp_extract("rest", pattern, 1), F.regexp_extract(F.btrim("text"), fixed, 1)
    rows = rows.withColumn("word", F.when(word != "", word).otherwise(constant)).withColumn("found", F.when(word != "", F.regexp_extract("rest", pattern, 2)).otherwise(F.regexp_extract(F.btrim("text"), fixed, 2)))
    known = F.element_at(kinds, F.concat_ws(" ", "language", "word"))
    kind, name = F.when(known.isNotNull(), known), F.when(known.isNotNull(), F.col("found"))
    go = F.regexp_extract(F.btrim("text"), r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)", 1)
    go_type = F.regexp_extract(F.btrim("text"), r"^type\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    is_go = F.col("language") == "go"
    kind = kind.when(is_go & (go != ""), "function").when(is_go & (go_type != ""), F.when(F.contains("text", F.lit(" struct")), "struct").when(F.contains("text", F.lit(" interface")), "interface").otherwise("type"))
    name = name.when(is_go & (go != ""), go).when(is_go & (go_type != ""), go_type)
    for languages, pattern_, kind_ in MORE:  # before what the keywords say
        got = F.when(F.col("language").isin(*languages), F.nullif(F.regexp_extract("text", pattern_, 1), F.lit("")))
        kind, name = F.when(got.isNotNull(), F.lit(kind_)).otherwise(kind), F.coalesce(got, name)
    signature = F.substring(F.rtrim(F.regexp_replace(F.btrim("text"), r"\{\s*$", "")), 1, 180)
    found = rows.select("path", "n_lines", name.alias("name"), kind.alias("kind"), F.col("line").alias("line_start"), signature.alias("signature")).where("name is not null")
    first = Window.partitionBy("path", "name", "kind").orderBy("line_start")
    found = found.withColumn("k", F.row_number().over(first)).where("k = 1")
    w = Window.partitionBy("path").orderBy("line_start")
    end = F.greatest(F.coalesce(F.lead("line_start").over(w) - 1, F.col("n_lines").cast("long")), F.col("line_start"))
    return found.select("path", "name", "kind", "line_start", end.alias("line_end"), "signature")


def identifier(name: Column) -> Column:
    """A regular expression of a name between identifier boundaries."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_$])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_$])"))


def reference_kind(line: Column | str, name: Column | str, kind: Column | str) -> Column:
    """What a line does with a symbol; the first that fits."""
    t, n, k = col(line), col(name), col(kind)
    trimmed, low, like = F.ltrim(t), F.lower(F.ltrim(t)), k.isin(*TYPE_LIKE)
    call = F.rlike(t, F.concat(identifier(n), F.lit(r"\s*\(")))
    member = F.rlike(t, F.concat(F.lit(r"(\.|::|->)\s*"), identifier(n), F.lit(r"\s*\(")))
    makes = F.rlike(t, F.concat(F.lit(r"new\s*"), identifier(n))) | F.rlike(t, F.concat(identifier(n), F.lit(r"\s*[({]")))
    base = F.rlike(trimmed, F.concat(F.lit(r"^class .*?\(.*"), identifier(n), F.lit(r".*\).*:$")))
    return (
        F.when(trimmed.rlike(r"^(use|import|from) ") | F.contains(t, F.lit("require(")), "import")
        .when(like & (low.rlike(r"^impl[ <]") | F.contains(low, F.lit(" implements ")) | F.contains(low, F.lit(": implements "))), "implementation")
        .when(like & (F.contains(F.lower(t), F.lit(" extends ")) | base), "inheritance")
        .when(like & t.rlike(r"[:<>&*]|->|=>| as "), "type_reference")
        .when(like & makes, "instantiation")
        .when((k == "function") & member, "method_call")
        .when((k == "function") & call, "call")
        .otherwise("reference")
    )


def references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line_start, target_path, target_name, target_kind, kind): identifier tokens that name a symbol, but for its
    own declaration. Among symbols of one name the file's own hide the rest, else those of files that the file
    imports; calls of members keep all.

    Tokens meet the file's own symbols by name and path, then those that it imports by name and a word of its imports, and
    only what is left, and calls of members, meet all symbols of their name: a name that many files declare makes no more
    rows than it has references. What a line does is told before, so no text is carried along.

    Names, tokens and what is open are used in several places each, and are written down first: put into each other they make
    a plan of some hundred copies of the files, which the driver cannot hold.
    """
    symbols = keep(symbols.select("path", "name", "kind", "line_start"), "names")
    code = lines(files).where(~F.col("text").rlike(r"^\s*(//|/\*|\*|$)"))
    word = r"[\p{L}_$][\p{L}\p{N}_$]*"
    tokens = code.select("path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("name"))
    tokens = tokens.join(symbols.select("name").distinct(), "name", "left_semi")
    kinds = {"as_type": TYPE_LIKE[0], "as_function": "function", "as_other": ""}
    tokens = tokens.select("path", "line", "name", *(reference_kind("text", "name", F.lit(k)).alias(c) for c, k in kinds.items()))
    tokens = keep(tokens, "tokens")
    s = symbols.select(F.col("path").alias("target_path"), "name", F.col("kind").alias("target_kind"), F.col("line_start").alias("declared"))
    key = ["path", "line", "name"]
    elsewhere = (F.col("path") != F.col("target_path")) | (F.col("line") != F.col("declared"))
    met = lambda t, more: t.join(s, "name").where(elsewhere & more)

    own = tokens.join(s.withColumn("path", F.col("target_path")), ["name", "path"]).where(elsewhere)
    open_ = keep(tokens.join(own.select(key).distinct(), key, "left_anti"), "open")
    told = code.where(F.ltrim("text").rlike("^(use|import|from) ") | F.contains("text", F.lit("require("))).select("path", "text")
    words = told.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_$]+"), F.lit(0))).alias("key")).distinct()
    imports = told.groupBy("path").agg(F.array_join(F.collect_list("text"), "\n").alias("imports"))  # of one file
    stem = F.regexp_extract("target_path", r"([^/.]+)\.[^/]*$", 1)
    by_stem = s.withColumn("stem", stem).withColumn("key", F.regexp_extract("stem", r"[\p{L}\p{N}_$]+", 0)).where("key <> ''")
    near = open_.select("path", "name").distinct().join(words, "path").join(by_stem, ["name", "key"]).join(imports, "path").where(F.rlike("imports", identifier(F.col("stem"))))
    known = keep(open_.join(near.select("path", "name", "target_path", "target_kind", "declared"), ["path", "name"]).where(elsewhere), "known")
    rest = met(open_.join(known.select(key).distinct(), key, "left_anti"), F.lit(True))
    members = met(tokens.where("as_function = 'method_call'"), F.col("target_kind") == "function")

    kind = F.when(F.col("target_kind").isin(*TYPE_LIKE), F.col("as_type")).when(F.col("target_kind") == "function", F.col("as_function")).otherwise(F.col("as_other"))
    pick = lambda d: d.select("path", F.col("line").alias("line_start"), "target_path", F.col("name").alias("target_name"), "target_kind", kind.alias("kind"))
    return pick(own).unionByName(pick(known)).unionByName(pick(rest)).unionByName(pick(members)).distinct()


def parameter_count(signature: Column | str) -> Column:
    """Top-level parameters between the outermost parentheses; null without any, 0 for an empty pair."""
    s = col(signature)
    start = F.struct(*(F.lit(0).alias(n) for n in ("depth", "angle", "n")), F.lit(False).alias("seen"), F.lit(False).alias("done"))

    def step(a: Column, c: Column) -> Column:
        opens, closes = c.isin("(", "[", "{"), c.isin(")", "]", "}")
        depth = a["depth"] + opens.cast("int") - closes.cast("int")
        angle = F.greatest(a["angle"] + (c == "<").cast("int") - (c == ">").cast("int"), F.lit(0))
        comma = (c == ",") & (a["depth"] == 1) & (a["angle"] == 0)
        other = ~(opens | closes | c.isin("<", ">") | comma) & ~c.rlike(r"^\s$") & (a["depth"] == 1)
        new = F.struct(depth.alias("depth"), angle.alias("angle"), (a["n"] + comma.cast("int")).alias("n"), (a["seen"] | other).alias("seen"), (closes & (depth == 0)).alias("done"))
        return F.when(a["done"], a).otherwise(new)

    chars = F.filter(F.split(F.substring(s, F.locate("(", s), F.length(s)), ""), lambda c: c != "")
    return F.when(F.locate("(", s) > 0, F.aggregate(chars, start, step, lambda a: F.when(a["seen"], a["n"] + 1).otherwise(0)))


def code_only(line: Column | str) -> Column:
    """A line without its comment, quoted text blanked."""
    cut = F.regexp_replace(col(line), "(//|#).*$", "")
    return F.regexp_replace(cut, r""""(\\.|[^"\\])*("|$)|'(\\.|[^'\\])*('|$)|`(\\.|[^`\\])*(`|$)""", " ")


def branch_weight(line: Column | str) -> Column:
    """Branch words, ``&&``, ``||`` and ``?`` of a line."""
    low = F.lower(code_only(line))
    words = F.size(F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(*BRANCHES)))
    return words + F.regexp_count(low, F.lit(r"&&|\|\||\?"))


def body_metrics(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, complexity, depth, span): one branch more than its weights, deepest braces, lines. Lines meet their
    symbols by file, within the range."""
    at = lines(files).withColumn("code", code_only("text"))
    j = symbols.select("path", "name", "line_start", "line_end").join(at.select("path", "line", "code"), "path").where("line between line_start and line_end")
    brace = F.length(F.regexp_replace("code", r"[^{]", "")) - F.length(F.regexp_replace("code", r"[^}]", ""))
    w = Window.partitionBy("path", "name", "line_start").orderBy("line")
    j = j.withColumn("level", F.sum(brace).over(w)).withColumn("weight", branch_weight("code"))
    return j.groupBy("path", "name", "line_start").agg((1 + F.sum("weight")).alias("complexity"), F.greatest(F.max("level"), F.lit(0)).alias("depth"), (F.max("line") - F.min("line") + 1).alias("span"))


def body_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, line_start, body) with the lines of each symbol, the first to the last; of a file that is not there or
    ends before, none."""
    text = files.select("path", F.split("text", "\n").alias("all"))
    n = F.greatest(F.least(F.col("line_end"), F.size("all").cast("long")) - F.col("line_start") + 1, F.lit(0))
    return symbols.join(text, "path").select("path", "name", "line_start", F.slice("all", F.col("line_start").cast("int"), n.cast("int")).alias("body"))


def diagnostics_of(output: DataFrame) -> DataFrame:
    """(command, severity, code, message, path, line_start) of (command, line, text): a header such as
    ``error[E1]: message`` with the ``-->`` place after it, and ``path:line:col: error: message``."""
    w = Window.partitionBy("command").orderBy("line")
    head = r"^(error|warning)(?:\[([A-Z0-9]+)\])?:\s*(.+)$"
    place = r"^\s*-->\s*(.+?):(\d+):\d+\s*$"
    colon = r"^([^\s:][^:]*):(\d+):\d+:\s*(?:fatal )?(error|warning|note):\s*(.+)$"
    t = F.col("text")
    what = F.when(t.rlike(head), "head").when(t.rlike(place), "place").when(t.rlike(colon), "colon")
    rows = output.withColumn("what", what).where("what is not null").withColumn("next", F.lead("what").over(w)).withColumn("next_text", F.lead("text").over(w))
    pick = lambda pattern, group, c="text": F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    placed = F.col("next") == "place"
    return rows.where("what <> 'place'").select(
        "command",
        F.coalesce(pick(head, 1), pick(colon, 3)).alias("severity"),
        pick(head, 2).alias("code"),
        F.coalesce(pick(head, 3), pick(colon, 4)).alias("message"),
        F.when(F.col("what") == "colon", pick(colon, 1)).when(placed, pick(place, 1, "next_text")).alias("path"),
        F.when(F.col("what") == "colon", pick(colon, 2)).when(placed, pick(place, 2, "next_text")).cast("long").alias("line_start"),
    )
