"""Scripts read by tokens: what stands in comments and strings does not count."""

import re

import pytest
from pyspark.sql import functions as F

from tabproof.functions.scripts import code_of, nondeterminism_flags, remap_references, tokens

SQL = [
    "SELECT rand() -- now()\nFROM t", "/* rand() * / */ now", "SELECT 'it''s rand()', \"uuid()\" FROM t", r"SELECT 'a\'rand()' , first(x)",
    "SELECT `rand() -- x`, last(y)", "-- rand()", "/* rand()", "'rand()", "a--b\r\nnow", "SELECT 1 - -2, '', rand()", "", "/**/now/***/", "'\\", "x /* ' */ y ' -- ' z",
]
PYTHON = ["x = rand()  # now()", '"""rand()\n"""\nfirst(x)', "'''a ' rand() ''' + now", "'it\\'s rand()' # x", "s = 'open rand()\nnow", "f('', \"#\", rand())",
          "'''rand()", "a = '' + uuid()"]


def plain_sql(text):
    """Comments and strings by a loop over characters."""
    out, i = "", 0
    while i < len(text):
        two = text[i:i + 2]
        if two == "--":
            while i < len(text) and text[i] not in "\r\n":
                i += 1
            out += " "
        elif two == "/*":
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            out += " "
        elif text[i] in "'\"":
            q, i = text[i], i + 1
            while i < len(text):
                if text[i] == "\\" and i + 1 < len(text):
                    i += 2
                elif text[i] == q and text[i + 1:i + 2] == q:
                    i += 2
                elif text[i] == q:
                    break
                elif text[i] == "\\":
                    break
                else:
                    i += 1
            if text[i:i + 1] == "\\":  # a last backslash ends nothing and begins nothing
                return None
            i += 1
            out += " "
        elif text[i] == "`" and (m := re.compile("`(?:[^`]|``)*`").match(text, i)):
            out, i = out + " " + m[0], m.end()
        else:
            out, i = out + text[i], i + 1
    return out


def test_code_without_comments_and_strings(spark):
    found = [r[0] for r in spark.createDataFrame([(t,) for t in SQL], "t string").select(code_of(F.col("t"), "sql")).collect()]
    for text, code in zip(SQL, found):
        expected = plain_sql(text)
        assert expected is None or code == expected, text


def flags(spark, texts, language):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(nondeterminism_flags(F.col("t"), language)).collect()]


def test_flags_in_code_only(spark):
    assert flags(spark, SQL, "sql") == [["random"], ["clock"], [], ["unordered"], ["random", "unordered"], [], [], [], ["clock"], ["random"], [], ["clock"], [], []]
    assert flags(spark, PYTHON, "python") == [["random"], ["unordered"], ["clock"], [], ["clock"], ["random"], [], ["random"]]
    assert flags(spark, SQL[:1], None) == [["clock", "random"]]


@pytest.mark.parametrize("quote", ["'", '"', "/*", "--"])
def test_long_texts_need_no_stack(spark, quote):
    for inner in ("x" * 300_000, "x\\n" * 100_000, "'' \"\" * " * 50_000):
        text = quote + inner.replace("\"", "'" if quote == '"' else "\"") + " now()"
        assert code_of is not None and isinstance(flags(spark, [text], "sql")[0], list)


def test_tokens(spark):
    text = "SELECT a1, 'x y', `b c` FROM t.größe -- end\nWHERE 2.5e3 /* k */ <> \"q\""
    row = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), "sql").alias("k")).first()
    assert [(t.kind, t.token) for t in row.k] == [
        ("word", "SELECT"), ("word", "a1"), ("sign", ","), ("string", "'x y'"), ("sign", ","), ("name", "`b c`"), ("word", "FROM"), ("word", "t"),
        ("sign", "."), ("word", "größe"), ("comment", "-- end"), ("word", "WHERE"), ("number", "2.5e3"), ("comment", "/* k */"), ("sign", "<"),
        ("sign", ">"), ("string", '"q"')]


def test_references_in_comments_and_strings_stay(spark):
    text = "FROM p.g.t -- p.g.t\n JOIN `p`.`g`.`t` /* p.g.t */ ON 'p.g.t' = \"p.g.t\" AND P.G.T.x"
    rows = spark.createDataFrame([(text,)], "source string")
    done = remap_references(rows, {"p.g.t": "l.b.one"}, language="sql").first()
    assert done.source == "FROM l.b.one -- p.g.t\n JOIN l.b.one /* p.g.t */ ON 'p.g.t' = \"p.g.t\" AND l.b.one.x"
    assert done.replacements == {"p.g.t": 3} and done.safe and done.residual == []
    assert remap_references(rows, {"p.g.t": "l.b.one"}).first().replacements == {"p.g.t": 7}
    kept = remap_references(rows, {"p.g.t": "P.G.t"}, language="sql").first()
    assert not kept.safe and kept.residual == ["p.g.t"]
