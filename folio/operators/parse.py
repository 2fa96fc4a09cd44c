"""Papers from LaTeX and page texts: sections, figures, tables, equations, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relations import carry_forward, section_parents

LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_HEADING = r"\\(section|subsection|subsubsection|paragraph)\*?\s*\{([^{}]+)\}"


def numbered(df: DataFrame, group: str, order, prefix: str, digits: int, name: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn(name, F.format_string(f"{prefix}%0{digits}d", n))


def _pieces(text: Column, pattern: str) -> Column:
    """A text cut in front of every match of the pattern; the piece before the first match comes first."""
    return F.split(text, f"(?={pattern})")


def sections(tex: DataFrame) -> DataFrame:
    """tex(paper_id, text) -> (paper_id, section_id, order, level, title, parent, body): a heading and the text up to the next."""
    p = tex.select("paper_id", F.posexplode(_pieces(T.strip_comments(F.col("text")), _HEADING)).alias("pos", "piece"))
    s = p.withColumn("command", F.regexp_extract("piece", f"^{_HEADING}", 1)).where("command <> ''")
    s = s.withColumn("level", F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("command"))).withColumn("title", T.clean_latex(F.regexp_extract("piece", f"^{_HEADING}", 2))).withColumn("body", F.regexp_replace("piece", f"^{_HEADING}", ""))
    s = numbered(s, "paper_id", "pos", "sec_tex_", 3, "section_id").withColumn("order", F.row_number().over(Window.partitionBy("paper_id").orderBy("pos")) - 1)
    return section_parents(s, "paper_id", "order", "level", "section_id", 4).select("paper_id", "section_id", "order", "level", "title", "parent", "body")


def environments(tex: DataFrame, *names: str) -> DataFrame:
    """(paper_id, n, name, block): the environments of these names, in the order in which they stand."""
    one = "|".join(names)
    found = F.regexp_extract_all(T.strip_comments(F.col("text")), F.lit(rf"(?s)(\\begin\{{(?:{one})\*?\}}.*?\\end\{{(?:{one})\*?\}})"), F.lit(1))
    return tex.select("paper_id", F.posexplode(found).alias("n", "block")).withColumn("name", F.regexp_extract("block", r"^\\begin\{(\w+)", 1))


def _caption(block: Column) -> Column:
    return T.clean_latex(F.regexp_extract(block, r"(?s)\\caption(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}", 1))


_LABEL = r"\\label\s*\{([^{}]+)\}"


def figures(tex: DataFrame) -> DataFrame:
    e = numbered(environments(tex, "figure"), "paper_id", "n", "fig_", 3, "figure_id")
    return e.select("paper_id", "figure_id", (F.col("n") + 1).cast("string").alias("number"), F.regexp_extract("block", r"\\includegraphics(?:\[[^\]]*\])?\s*\{([^{}]+)\}", 1).alias("file"), _caption(F.col("block")).alias("caption"), F.regexp_extract("block", _LABEL, 1).alias("label"))


def tables(tex: DataFrame) -> DataFrame:
    e = numbered(environments(tex, "table"), "paper_id", "n", "table_", 3, "table_id")
    return e.select("paper_id", "table_id", (F.col("n") + 1).cast("string").alias("number"), _caption(F.col("block")).alias("caption"), F.regexp_extract("block", _LABEL, 1).alias("label"), F.col("block").alias("latex"))


def equations(tex: DataFrame) -> DataFrame:
    e = numbered(environments(tex, "equation", "align"), "paper_id", "n", "eq_", 3, "equation_id")
    inner = F.regexp_replace(F.regexp_replace("block", r"\\(?:begin|end)\{\w+\*?\}", ""), _LABEL, "")
    return e.select("paper_id", "equation_id", F.regexp_extract("block", _LABEL, 1).alias("label"), F.trim(inner).alias("latex"))


def paragraphs(tex: DataFrame) -> DataFrame:
    """Paragraphs of at least 20 characters with the section they stand in. Only the document's body counts, and a heading is
    never part of a paragraph: text around it is cut there."""
    text = F.regexp_replace(T.strip_comments(F.col("text")), r"(?s)^.*?\\begin\{document\}|\\end\{document\}.*$", "")
    for name in T.LATEX_BLOCKS:
        text = F.regexp_replace(text, rf"(?s)\\begin\{{{name}\*?\}}.*?\\end\{{{name}\*?\}}", "\n\n")
    p = tex.select("paper_id", F.posexplode(_pieces(text, _HEADING)).alias("pos", "piece"))
    p = p.withColumn("section_no", F.sum(F.col("piece").rlike(f"^{_HEADING}").cast("int")).over(Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    p = p.select("paper_id", "pos", "section_no", F.posexplode(F.split(F.regexp_replace("piece", f"^{_HEADING}", ""), r"\n\s*\n")).alias("sub", "raw")).withColumn("text", T.clean_latex(F.col("raw"))).where(F.length("text") >= 20)
    p = numbered(p.withColumn("at", F.struct("pos", "sub")), "paper_id", "at", "para_tex_", 5, "paragraph_id")
    return p.select("paper_id", "paragraph_id", "text", F.when(F.col("section_no") > 0, F.format_string("sec_tex_%03d", F.col("section_no"))).alias("section_id"))


def page_lines(pages: DataFrame) -> DataFrame:
    """pages(paper_id, page, text) -> lines with kind heading or paragraph, and the section in force."""
    p = pages.select("paper_id", "page", F.posexplode(T.heading_lines(F.col("text"))).alias("pos", "text")).withColumn("at", F.struct("page", "pos")).withColumn("heading", T.is_heading(F.col("text")))
    n = F.sum(F.col("heading").cast("int")).over(Window.partitionBy("paper_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("own", F.when(F.col("heading"), F.format_string("sec_pdf_%03d", n)))
    return carry_forward(p, "paper_id", "at", F.col("own"), "section_id").select("paper_id", "page", "pos", "text", "heading", "section_id")


# Fixed values that results depend on: how macros, titles and authors are found.
_MACRO = r"\\newcommand\*?\s*(?:\{\\([A-Za-z@]+)\}|\\([A-Za-z@]+))\s*\{([^{}]*)\}"
_VALUE = r"(?s)\\%s\s*\{((?:[^{}]|\{[^{}]*\})*)\}"
_AUTHOR_CUT = r"\\and|;"


def _value(text: Column, name: str) -> Column:
    """What stands in the first \\name{...}, white space as one blank; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(_VALUE % name), F.lit(1))
    return F.trim(F.regexp_replace(F.get(found, 0), r"\s+", " "))


def expanded_macros(text: Column, source: Column) -> Column:
    """text with the macros without arguments that source defines put in, the longest name first; of definitions of one name the last one counts."""
    braced, bare, values = (F.regexp_extract_all(source, F.lit(_MACRO), F.lit(k)) for k in (1, 2, 3))
    names = F.zip_with(braced, bare, lambda a, b: F.concat(a, b))  # one of the two is empty
    found = F.zip_with(names, values, lambda n, v: F.struct((-F.length(n)).alias("size"), n.alias("name"), v.alias("value")))
    macros = F.array_sort(F.transform(found, lambda m, i: F.struct(m["size"].alias("size"), (-i).alias("at"), m["name"].alias("name"), m["value"].alias("value"))))
    literal = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    return F.aggregate(macros, text, lambda have, m: F.regexp_replace(have, F.concat(F.lit(r"\\"), m["name"], F.lit(r"(?![A-Za-z@])(?:\{\})?")), literal(m["value"])))


def metadata(tex: DataFrame) -> DataFrame:
    """tex(paper_id, text) -> (paper_id, title, authors, abstract): title with its macros put in and cleaned, null if there is none or nothing is left of it; authors cut
    at \\and and semicolons; the first abstract. A paper without text has null, no authors and null."""
    raw = F.regexp_replace(expanded_macros(_value(F.col("text"), "title"), F.col("text")), r"\\(?:vspace|hspace)\*?\s*\{[^{}]*\}", " ")
    authors = F.filter(F.transform(F.split(F.coalesce(_value(F.col("text"), "author"), F.lit("")), _AUTHOR_CUT), lambda a: F.trim(a)), lambda a: a != "")
    abstract = F.get(F.regexp_extract_all("text", F.lit(r"(?s)\\begin\{abstract\*?\}(.*?)\\end\{abstract\*?\}"), F.lit(1)), 0)
    return tex.select("paper_id", F.nullif(T.clean_latex(raw), F.lit("")).alias("title"), authors.alias("authors"), T.clean_latex(abstract).alias("abstract"))


def merged_metadata(tex: DataFrame, pdf: DataFrame) -> DataFrame:
    """metadata() rows of both sources -> one for each paper: LaTeX's title, authors and abstract where it has any, else those of the PDF."""
    t, p = (x.select("paper_id", *[F.col(c).alias(f"{s}_{c}") for c in ("title", "authors", "abstract")]) for x, s in ((tex, "tex"), (pdf, "pdf")))
    either = lambda c: F.coalesce(F.when(F.length(f"tex_{c}") > 0, F.col(f"tex_{c}")), F.col(f"pdf_{c}")).alias(c)
    authors = F.coalesce(F.when(F.size("tex_authors") > 0, F.col("tex_authors")), "pdf_authors", F.array().cast("array<string>")).alias("authors")
    return t.join(p, "paper_id", "full").select("paper_id", either("title"), authors, either("abstract"))


def merge_warnings(tex: DataFrame, pdf: DataFrame) -> DataFrame:
    """(paper_id, warning) of papers whose LaTeX and PDF name titles that differ in more than case and white space."""
    both = tex.select("paper_id", F.col("title").alias("a")).join(pdf.select("paper_id", F.col("title").alias("b")), "paper_id").where("length(a) > 0 AND length(b) > 0")
    plain = lambda c: F.lower(T.collapse(F.col(c)))
    return both.where(plain("a") != plain("b")).select("paper_id", F.concat(F.lit("titles differ: "), "a", F.lit(" / "), "b").alias("warning"))
