"""Tables of LaTeX against grids written by hand and against a plain reader."""

import random

from pyspark.sql import functions as F

from folio.functions import tables

CASES = [
    (r"\begin{tabular}{lcr} a & b & c \\ 1 & 2 & 3 \end{tabular}", [["a", "b", "c"], ["1", "2", "3"]], 3),
    (r"x \begin{tabular*}{\textwidth}{@{}l|p{3cm}r@{\hskip {2pt}}} \toprule \textbf{a} & b\\[2pt] \midrule \multicolumn{2}{c}{x {y \emph{z}} & w} & q \\ \cmidrule(lr){1-2} \bottomrule \end{tabular*} y", [["a", "b"], ["x y z & w", "q"]], 3),
    (r"\begin{tabular}{l>{\bfseries}c} a \& b & 5\% % & comment" "\n" r" \\ \hline & \\ {} & $x^{2} \pm 1$ \\ \end{tabular}", [["a & b", "5%"], ["", "x^2 ±1"]], 2),
    (r"\begin{tabular}{l{c} never closed \end{tabular}", None, None),
    ("no table", None, None),
    ("", None, None),
    (None, None, None),
    (r"\begin{tabular}{|} a \end{tabular}", [["a"]], None),
    (r"\begin{tabular}{l}\end{tabular}", [], 1),
    (r"\begin{tabular}{l|ccc@{\hskip 1em}rrr}", None, 7),
    (r"\begin{tabular*}{\textwidth}{lp{2cm}X}", None, 3),
    (r"\begin{tabular}{lcc", None, None),
    (r"\begin{tabular}{lcc} \hline A & \multicolumn{2}{c}{B} \\ x & \$5 & 6\% \\ \end{tabular}", [["A", "B", ""], ["x", "$5", "6%"]], 3),
    (r"\begin{tabular}{ll} a} & b \end{tabular}", [["a", "b"]], 2),
    (r"\begin{tabular}{ll} \times & \uparrow \\ \bar{x} & y\\ \end{tabular} \begin{tabular}{l} second \end{tabular}", [["×", "↑"], ["x\u0304", "y"]], 2),
]


def test_grids_and_columns(spark):
    d = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(CASES)], "i int, x string")
    got = {r["i"]: (r["g"], r["c"], r["rows"]) for r in d.select("i", tables.grid(tables.parsed(F.col("x"))).alias("g"), tables.tabular_columns(F.col("x")).alias("c"), tables.tabular_rows(F.col("x")).alias("rows")).collect()}
    for i, (x, grid, columns) in enumerate(CASES):
        assert got[i] == (grid, columns, grid or []), x


def plain(body):
    """Cells of a body by a loop with a stack."""
    rows, row, cell, stack, i = [], [], "", [], 0
    while i < len(body):
        if body.startswith("\\\\", i) and not stack:
            rows, row, cell, i = [*rows, [*row, cell]], [], "", i + 2
            continue
        if body[i] == "\\":
            cell, i = cell + body[i : i + 2], i + 2
            continue
        if body[i] == "&" and not stack:
            row, cell = [*row, cell], ""
        else:
            if body[i] == "{":
                stack.append(i)
            elif body[i] == "}" and stack:
                stack.pop()
            cell += body[i]
        i += 1
    return [*rows, [*row, cell]]


def test_cells_follow_a_plain_reader(spark):
    rng = random.Random(4)
    bodies = ["x" + "".join(rng.choices(["a", "&", "{", "}", r"\\", r"\&", r"\{", " ", "b"], [5, 3, 2, 2, 2, 1, 1, 2, 4], k=60)) for _ in range(200)]
    d = spark.createDataFrame([(i, r"\begin{tabular}{ll}" + b + r"\end{tabular}") for i, b in enumerate(bodies)], "i int, x string")
    assert {r["i"]: r["rows"] for r in d.select("i", tables.parsed(F.col("x"))["rows"].alias("rows")).collect()} == {i: plain(b) for i, b in enumerate(bodies)}


def test_no_python_in_the_plan(spark):
    plan = spark.createDataFrame([("x",)], "x string").select(tables.tabular_rows(F.col("x")), tables.tabular_columns(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tokens_are_few(spark):
    row = r"\multicolumn{2}{c}{\textbf{x{1} & y}} & s\& 5 & $q^{2}$ \\[2pt] "
    n = spark.range(1).select(F.size(F.regexp_extract_all(F.lit(row * 50), F.lit(tables.TOKEN), F.lit(1)))).first()[0]
    assert n <= 50 * 8
