"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
GENERIC_TITLES = ("motivation", "method", "experiments", "results", "ablation study", "discussion", "conclusion", "动机", "方法", "实验", "结果", "消融实验", "结论")
BAD_TITLE_PUNCTUATION = ("—", ";", "|", "→")
FORBIDDEN_VOICE = ("we propose", "our method", "我们提出", "我们的方法")
TRAILING_PUNCTUATION = "。！？!?；;：:"
CJK = "[\\u4e00-\\u9fff]"
CJK_EXTENDED = "[\\u3400-\\u4dbf\\u4e00-\\u9fff]"
KEYWORD = "[a-z][a-z0-9-]{2,}|\\d+(?:\\.\\d+)?|[\\u4e00-\\u9fff]{2,}"
HEADING = r"^(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Za-z0-9 ,:&/\-]{2,80}$"
LATEX_BLOCKS = ("figure", "table", "equation", "align", "abstract")


def fold(x: Column) -> Column:
    """Caseless key: lower case, with ß as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_text(x: Column) -> Column:
    """White space collapsed, trimmed, folded: the form in which excerpts are looked up in sources."""
    return fold(collapse(x))


def claim_key(x: Column) -> Column:
    """Letters and digits only, folded."""
    return fold(F.regexp_replace(x, r"(?U)[\W_]+", ""))


def contains_cjk(x: Column) -> Column:
    return F.coalesce(x.rlike(CJK_EXTENDED), F.lit(False))


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 48), "-+$", "")
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, "paper").otherwise(s)


def is_heading(x: Column) -> Column:
    return x.rlike(HEADING) & (F.size(F.split(x, " ")) <= 10)


def ends_with_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+$", "").rlike(f"[{TRAILING_PUNCTUATION}]$")


def strip_trailing_punctuation(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+$", ""), f"[{TRAILING_PUNCTUATION}]+$", ""), r"\s+$", "")


def title_problems(x: Column) -> Column:
    """Names of the title rules that a title breaks, in rule order."""
    name = F.regexp_replace(fold(F.trim(x)), r"\.+$", "")
    rules = [("generic", name.isin(*GENERIC_TITLES)), ("trailing_period", x.endswith(".") & (F.length(x) < 90)), ("punctuation", F.coalesce(*[F.when(x.contains(p), True) for p in BAD_TITLE_PUNCTUATION], F.lit(False))), ("too_long", F.length(x) > 110)]
    return F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in rules]))


def own_voice(x: Column) -> Column:
    """Whether a text speaks as the paper's authors."""
    low = fold(x)
    return F.coalesce(*[F.when(low.contains(p), True) for p in FORBIDDEN_VOICE], F.lit(False))


def keywords(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(x), F.lit(f"({KEYWORD})"), F.lit(1)))


def cjk_bigrams(x: Column) -> Column:
    only = F.regexp_replace(x, "[^\\u4e00-\\u9fff]", "")
    return F.when(F.length(only) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(only) - 1), lambda i: F.substring(only, i, 2)))).otherwise(F.array().cast("array<string>"))


def keyword_overlap(a: Column, b: Column) -> Column:
    """A shared keyword, or else a shared pair of neighbouring CJK characters."""
    return F.coalesce(F.arrays_overlap(keywords(a), keywords(b)), F.lit(False)) | F.coalesce(F.arrays_overlap(cjk_bigrams(a), cjk_bigrams(b)), F.lit(False))


def strip_comments(x: Column) -> Column:
    """LaTeX comments removed: an escaped percent sign is text, one behind an even number of backslashes starts a comment."""
    kept = F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\%", "$1\u0001")
    return F.regexp_replace(F.regexp_replace(kept, "(?m)%.*$", ""), "\u0001", "%")


def clean_latex(x: Column) -> Column:
    """Plain text of a LaTeX paragraph: no comments, citations, commands or braces, white space collapsed."""
    y = F.regexp_replace(strip_comments(x), r"\\(?:cite\w*|ref|label|eqref|autoref)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "")
    y = F.regexp_replace(y, r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?|[{}]", "")
    return collapse(F.replace(y, F.lit("~"), F.lit(" ")))


# Signs that cells keep, and an overlined letter.
CELL_SIGNS = (
    (r"\\(?:cdot|times)(?![A-Za-z])\s?", "×"),
    (r"\\pm(?![A-Za-z])\s?", "±"),
    (r"\\uparrow(?![A-Za-z])", "↑"),
    (r"\\downarrow(?![A-Za-z])", "↓"),
    (r"\\(?:bar|overline)\s*\{([A-Za-z])\}", "$1\u0304"),
)


def clean_cell(x: Column, passes: int = 4) -> Column:
    """Text of a table cell: styling commands unwrapped up to `passes` levels deep, signs written out, other commands and spacing dropped."""
    x = F.regexp_replace(x, r"\\\$", "\u0002")  # a dollar that is none of mathematics
    for pattern, sign in CELL_SIGNS:
        x = F.regexp_replace(x, pattern, sign)
    y = F.regexp_replace(x, r"\\(?:hline|toprule|midrule|bottomrule|cmidrule(?:\([^)]*\))?\{[^}]*\}|cline\{[^}]*\})", " ")
    y = F.regexp_replace(y, r"\\multicolumn\{[^{}]*\}\{[^{}]*\}", "")
    for _ in range(passes):
        y = F.regexp_replace(y, r"\\[A-Za-z]+\*?\{([^{}]*)\}", "$1")
    y = F.regexp_replace(F.regexp_replace(y, r"\\([%&_#])", "$1"), r"\\[A-Za-z]+\s?|[${}]", "")
    return F.translate(collapse(F.regexp_replace(y, r"~|\\,|\\ ", " ")), "\u0002", "$")


def heading_lines(text: Column) -> Column:
    """Lines of a page's text: split at blank lines and line ends, white space collapsed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n|\n"), collapse), lambda x: x != "")
