"""Texts of scripts: table references in them, and signs of results that do not repeat."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Calls whose result depends on the clock, on chance or on row order.
NONDETERMINISM = {
    "clock": r"(?i)\b(current_timestamp|current_date|localtimestamp|now|getdate|unix_timestamp\(\s*\))",
    "random": r"(?i)\b(rand|randn|random|uuid|shuffle|monotonically_increasing_id)\s*\(",
    "unordered": r"(?i)\b(collect_list|collect_set|array_agg|first|first_value|last|last_value|any_value)\s*\(",
}

# What is no code, by language: comments, and strings with their escapes. An end that is missing is the end of the text. The parts
# never give back what they have taken, so that long ones need no stack.
_DOUBLE = r"""(?:[^"\\]++|\\[\s\S]|"")*+(?:"|\z)"""
_SINGLE = r"""(?:[^'\\]++|\\[\s\S]|'')*+(?:'|\z)"""
NO_CODE = {
    "sql": "|".join([r"--[^\r\n]*+", r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)", "'" + _SINGLE, '"' + _DOUBLE]),
    "python": "|".join([
        r"#[^\r\n]*+", r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:"""|\z)', r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'''|\z)",
        r'"(?:[^"\\\r\n]++|\\[\s\S])*+(?:"|(?=[\r\n])|\z)', r"'(?:[^'\\\r\n]++|\\[\s\S])*+(?:'|(?=[\r\n])|\z)"]),
}
# A name in backticks is read as one, so that no comment or string starts inside it.
QUOTED_NAME = r"`(?:[^`]|``)*+`"
KINDS = {"sql": {"--": "comment", "/*": "comment", "'": "string", '"': "string", "`": "name"},
         "python": {"#": "comment", "'": "string", '"': "string", "`": "name"}}


def code_of(text: Column, language: str) -> Column:
    """The text with each comment and string of the language replaced by a space."""
    return F.regexp_replace(text, F.lit(f"(?:{NO_CODE[language]})|({QUOTED_NAME})"), F.lit(" $1"))


def tokens(text: Column, language: str) -> Column:
    """The parts of a text in order: an array of (kind, token). Kinds: comment, string, name (in backticks), word, number, sign."""
    rest = r"[\p{L}_][\p{L}\p{N}_$]*+|\p{N}[\p{L}\p{N}_.]*+|[^\s\p{L}\p{N}_]"
    found = F.regexp_extract_all(text, F.lit(f"{NO_CODE[language]}|{QUOTED_NAME}|{rest}"), F.lit(0))

    def kind(token: Column) -> Column:
        of = F.when(F.rlike(token, F.lit(r"^[\p{L}_]")), "word").when(F.rlike(token, F.lit(r"^\p{N}")), "number")
        for start, name in KINDS[language].items():
            of = of.when(F.startswith(token, F.lit(start)) & (F.length(token) > (0 if name == "comment" else 1)), name)
        return of.otherwise("sign")

    return F.transform(found, lambda t: F.struct(kind(t).alias("kind"), t.alias("token")))


def reference_pattern(table: str) -> str:
    """Regular expression of a whole table reference: any letter case, parts in backticks or not.

    Not preceded by a word character, dot or backtick, nor followed by a word
    character or backtick, so that longer names are left alone.
    """
    parts = r"\s*\.\s*".join(f"`?{re.escape(p)}`?" for p in table.replace("`", "").split("."))
    return rf"(?i:(?<![\w.`]){parts}(?![\w`]))"


def remap_references(scripts: DataFrame, mapping: dict[str, str], text: str = "source", language: str | None = None) -> DataFrame:
    """Replaces every reference to a mapped table in ``text`` by its new name.

    Adds ``replacements``, the count per table, ``residual``, the mapped tables
    still referred to afterwards, and ``safe``, whether there are none. With a ``language``, references in its comments and
    strings stay as they are and don't count.
    """
    names = {t.replace("`", "").lower(): t for t in mapping}
    # One expression for all tables; what it finds is told apart by its text without backticks and white space.
    wanted = [reference_pattern(t) for t in sorted(mapping, key=len, reverse=True)]
    pattern = F.lit("|".join(([NO_CODE[language]] if language else []) + wanted))
    plain = lambda found: F.lower(F.regexp_replace(found, r"[`\s]", ""))
    every = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    found = F.transform(every, plain)
    new_names = F.create_map(*[F.lit(x) for name, t in names.items() for x in (name, mapping[t])])
    between = F.split(F.col(text), pattern, -1)
    put = (lambda f, i: new_names[f]) if language is None else (lambda f, i: F.coalesce(new_names[f], F.get("__every", i)))
    woven = F.concat(F.array_join(F.transform("__found", lambda f, i: F.concat(
        F.element_at("__between", i + 1), put(f, i))), ""), F.element_at("__between", -1))

    def times(name: str) -> Column:
        return F.size(F.filter("__found", lambda found: found == name))

    counts = [x for name, t in names.items() for x in (F.lit(t), times(name))]
    left = F.transform(F.regexp_extract_all(F.col(text), pattern, F.lit(0)), plain)
    residual = F.array_compact(F.array(*[F.when(F.array_contains("__left", n), F.lit(t)) for n, t in names.items()]))
    return (
        scripts.withColumn("__every", every if language else F.lit(None)).withColumn("__found", found).withColumn("__between", between)
        .withColumn("replacements", F.create_map(*counts)).withColumn(text, woven)
        .withColumn("__left", left).withColumn("residual", residual).withColumn("safe", F.size("residual") == 0)
        .drop("__every", "__found", "__between", "__left")
    )


def nondeterminism_flags(text: Column, language: str | None = None) -> Column:
    """The kinds of call in the text that may give another result on another run; with a ``language``, in its code only."""
    text = text if language is None else code_of(text, language)
    return F.array_compact(F.array(*[
        F.when(F.rlike(text, F.lit(pattern)), F.lit(kind)) for kind, pattern in NONDETERMINISM.items()]))
