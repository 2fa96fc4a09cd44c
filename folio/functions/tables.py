"""LaTeX tables as grids of texts, within the JVM: a fold over tokens that keeps the depth of braces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Leading groups of a tabular: widths and the column declaration.
MOST_GROUPS = 4
# Fixed values that results depend on: letters that declare a column, and commands that are rules between rows.
COLUMN_LETTERS = "lcrpmbX"
RULES = r"\\(?:toprule|midrule|bottomrule|hline)(?![A-Za-z])|\\specialrule\{[^{}]*\}\{[^{}]*\}\{[^{}]*\}"


def _group(levels: int) -> str:
    """A group in braces with its inner ones, `levels` deep, without row ends. Repetitions are bounded, since Java's recurse."""
    text = r"[^\\{}]*+(?:\\[^\\][^\\{}]*+){0,100}+"
    return r"\{" + text + (f"(?:{_group(levels - 1)}{text}){{0,50}}+" if levels > 1 else "") + r"\}"


#: A row's end; text with its escaped signs, commands and closed groups; white space; a closed group; or a brace, ampersand or backslash that is left.
TOKEN = r"(?s)(\\\\(?:\[[^\]]*\])?|(?:\s*+[^\\{}&\s]|\\[^\\])(?:[^\\{}&]++|\\[^\\]|" + _group(3) + r"){0,100}+|\s++|" + _group(3) + r"|[{}&]|\\)"
_FIELDS = (("depth", "int"), ("leading", "boolean"), ("groups", "array<string>"), ("cell", "string"), ("row", "array<string>"), ("rows", "array<array<string>>"))


def _state(s: Column, **new: Column) -> Column:
    return F.struct(*[new.get(n, s[n]).cast(kind).alias(n) for n, kind in _FIELDS])


def _step(s: Column, t: Column) -> Column:
    opens, closes, flat = t == "{", t == "}", s["depth"] == 0
    longer, empty = F.concat(s["cell"], t), F.lit("")
    deeper = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
    ended = F.concat(s["row"], F.array(s["cell"]))
    none = F.array().cast("array<string>")
    body = (
        F.when(flat & t.startswith("\\\\"), _state(s, leading=F.lit(False), row=none, cell=empty, rows=F.concat(s["rows"], F.array(ended))))
        .when(flat & (t == "&"), _state(s, leading=F.lit(False), row=ended, cell=empty))
        .otherwise(_state(s, leading=F.lit(False), depth=deeper, cell=longer))
    )
    inside = F.when(closes & (s["depth"] == 1), _state(s, depth=F.lit(0), cell=empty, groups=F.concat(s["groups"], F.array(s["cell"])))).otherwise(_state(s, depth=deeper, cell=longer))
    leading = F.when(flat & t.rlike(r"^\s+$"), s).when(flat & opens & (F.size(s["groups"]) < MOST_GROUPS), _state(s, depth=F.lit(1), cell=empty)).when(flat & t.startswith("{") & (F.size(s["groups"]) < MOST_GROUPS), _state(s, cell=empty, groups=F.concat(s["groups"], F.array(F.substr(t, F.lit(2), F.length(t) - 2))))).when(flat, body).otherwise(inside)
    return F.when(s["leading"], leading).otherwise(body)


def parsed(latex: Column) -> Column:
    """struct<groups, rows> of the first tabular: its leading groups as written, and its rows of cells as written. Null without one, or where the braces of its declaration do not match; without an end it has no rows.

    Ampersands and row ends count outside braces alone; rules between rows end a row; comments go first. The fold is linear in the tokens of a table, but for its own cells, which it holds."""
    clean = T.strip_comments(latex)
    inner = r"(?s)\\begin\{tabular\*?\}(.*?)(?:\\end\{tabular|\z)"
    closed = clean.rlike(r"(?s)\\begin\{tabular\*?\}.*\\end\{tabular")
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract(clean, inner, 1), RULES, r"\\\\\\\\"), r"\\(?:cline|cmidrule(?:\([^)]*\))?)\{[^}]*\}", "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("leading"), F.array().cast("array<string>").alias("groups"), F.lit("").alias("cell"), F.array().cast("array<string>").alias("row"), F.array().cast("array<array<string>>").alias("rows"))
    end = lambda s: F.when(~(s["leading"] & (s["depth"] > 0)), F.struct(s["groups"].alias("groups"), F.when(closed, F.concat(s["rows"], F.array(F.concat(s["row"], F.array(s["cell"]))))).alias("rows")))
    return F.when(clean.rlike(inner), F.aggregate(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(1)), zero, _step, end))


def grid(table: Column) -> Column:
    """Cells of a parsed table as readable texts, rows without any left out, all as long as the longest."""
    rows = F.filter(F.transform(table["rows"], lambda r: F.transform(r, lambda c: T.clean_cell(c))), lambda r: F.exists(r, lambda c: c != ""))
    longest = lambda all_rows: F.struct(all_rows.alias("rows"), F.array_max(F.transform(all_rows, F.size)).alias("n"))
    filled = lambda x: F.transform(x["rows"], lambda r: F.concat(r, F.array_repeat(F.lit(""), x["n"] - F.size(r))))
    return F.get(F.transform(F.transform(F.array(rows), longest), filled), 0)


def column_count(latex: Column, table: Column) -> Column:
    """Columns that a parsed table declares: those of its second group for tabular*, else of its first; null if there are none. What stands in braces behind a letter or an at sign is none."""
    starred = F.regexp_extract(T.strip_comments(latex), r"\\begin\{tabular(\*?)\}", 1) == "*"
    spec = F.get(table["groups"], F.when(starred, 1).otherwise(0))
    braced = r"\{(?:[^{}]|\{[^{}]*\})*\}"
    plain = F.regexp_replace(F.regexp_replace(spec, f"[@!><]{braced}", ""), f"([pmb]){braced}", "$1")
    return F.nullif(F.length(F.regexp_replace(plain, f"[^{COLUMN_LETTERS}]", "")), F.lit(0))


def tabular_rows(latex: Column) -> Column:
    return F.coalesce(grid(parsed(latex)), F.array().cast("array<array<string>>"))


def tabular_columns(latex: Column) -> Column:
    return column_count(latex, parsed(latex))
