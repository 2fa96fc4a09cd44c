"""Formulas as readable text: a recursive reader of LaTeX's braces, commands and scripts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: signs, words and spaces that commands stand for.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "Delta": "Δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ",
    "kappa": "κ", "lambda": "λ", "Lambda": "Λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "Sigma": "Σ", "tau": "τ",
    "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Omega": "Ω",
}
SIGNS = {
    "pm": "±", "mp": "∓", "times": "×", "cdot": "·", "div": "÷", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "approx": "≈", "equiv": "≡",
    "propto": "∝", "in": "∈", "notin": "∉", "subset": "⊂", "mid": "|", "star": "⋆", "ast": "∗", "to": "→", "rightarrow": "→", "mapsto": "↦", "infty": "∞",
    "partial": "∂", "nabla": "∇", "sum": "Σ", "prod": "Π", "int": "∫", "min": "min", "max": "max", "log": "log", "exp": "exp", "det": "det",
    "argmin": "arg min", "argmax": "arg max", "sg": "sg", "quad": " ", "qquad": " ",
}
#: Commands of which nothing stays but what follows them.
SILENT = frozenset("mathcal mathbf mathrm mathit mathsf mathbb boldsymbol operatorname text textbf texttt displaystyle textstyle limits nolimits left right big Big bigg Bigg bm sf tt boxed".split())
#: Commands that vanish with the group behind them.
DROPPED = frozenset("label tag nonumber begin end color".split())
FRACTIONS = frozenset(("frac", "tfrac", "dfrac"))
ACCENTS = {"hat": "̂", "bar": "̄", "overline": "̄", "tilde": "̃", "dot": "̇"}
COMPOSED = {
    "̂": dict(zip("aceghijosuwyz", "âĉêĝĥîĵôŝûŵŷẑ", strict=True)),
    "̄": dict(zip("aeiou", "āēīōū", strict=True)),
    "̃": dict(zip("ano", "ãñõ", strict=True)),
}
RAISED = dict(zip("0123456789+-=()inT", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁱⁿᵀ", strict=True))
LOWERED = dict(zip("0123456789+-=aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", strict=True))
#: Groups within groups that are followed; what lies deeper stays as it is written.
DEPTH = 200


def _tidy(x: str) -> str:
    x = re.sub(r"[_^]\s+", lambda m: m[0].strip(), x)
    x = re.sub(r"\s*\n\s*", " ", re.sub(r"[ \t]+", " ", x))
    return re.sub(r"\s+([,;.)\]])", r"\1", x).strip()


class _Reader:
    """One formula, read from left to right; every group is a formula of its own."""

    def __init__(self, text: str):
        self.text, self.partner, open_ = text, {}, []
        for i, c in enumerate(text):
            if c == "{":
                open_.append(i)
            elif c == "}" and open_:
                self.partner[open_.pop()] = i

    def argument(self, at: int, end: int, depth: int) -> tuple[str, int] | None:
        """The group, command or character that starts at or, behind white space, after `at`, as text, and the place behind it."""
        while at < end and self.text[at].isspace():
            at += 1
        if at >= end or self.text[at] == "}":
            return None
        if self.text[at] == "{":
            close = self.partner.get(at)
            return None if close is None else (self.span(at + 1, close, depth + 1), close + 1)
        if self.text[at] == "\\":
            name = re.compile(r"\\[A-Za-z]+").match(self.text, at, end)
            return None if name is None else (self.span(at, name.end(), depth + 1), name.end())
        return self.text[at], at + 1

    def command(self, name: str, at: int, end: int, depth: int) -> tuple[str, int]:
        """Text of a command whose name ends at `at`, and the place behind what it takes. Without its arguments it stays as written."""
        if name in GREEK or name in SIGNS:
            return GREEK.get(name) or SIGNS[name], at
        if name in SILENT:
            return "", at
        if name in DROPPED:
            got = self.argument(at, end, depth) if self.text[at : at + 1] == "{" else None
            return ("", got[1]) if got else ("", at)
        wanted = 2 if name in FRACTIONS else 1 if name == "sqrt" or name in ACCENTS else 0
        args, to = [], at
        for _ in range(wanted):
            got = self.argument(to, end, depth)
            if got is None:
                return f"\\{name}", at
            args.append(got[0])
            to = got[1]
        if name in FRACTIONS:
            return f"({args[0]})/({args[1]})", to
        if name == "sqrt":
            return f"√({args[0]})", to
        if name in ACCENTS:
            base = args[0].strip()
            return COMPOSED.get(ACCENTS[name], {}).get(base.lower(), base + ACCENTS[name]), to
        return f"\\{name}", at

    def script(self, mark: str, at: int, end: int, depth: int) -> tuple[str, int]:
        """A script in braces: words and numbers keep the mark, others become raised or lowered characters where all exist, else a bracket."""
        close = self.partner.get(at) if at < end and self.text[at] == "{" else None
        if close is None:
            return mark, at
        inner = self.span(at + 1, close, depth + 1).strip()
        table = RAISED if mark == "^" else LOWERED
        if re.fullmatch(r"[A-Za-z0-9]+", inner):
            return mark + inner, close + 1
        return ("".join(table[c] for c in inner) if all(c in table for c in inner) else f"{mark}({inner})"), close + 1

    def span(self, at: int, end: int, depth: int = 0) -> str:
        if depth > DEPTH:
            return self.text[at:end]
        out = []
        while at < end:
            c = self.text[at]
            if c == "\\":
                name = re.compile(r"\\([A-Za-z]+)").match(self.text, at, end)
                if name:
                    piece, at = self.command(name[1], name.end(), end, depth)
                else:
                    after = self.text[at + 1 : min(at + 2, end)]
                    piece = {"\\": "\n", "!": "", "|": "‖", "{": "", "}": ""}.get(after, " " if after and after in ",;:> " else after if after and after in "%#&_$" else "\\" + after)
                    at += 1 + len(after)
            elif c in "^_":
                piece, at = self.script(c, at + 1, end, depth)
            else:
                piece, at = ("" if c in "{}&" else c), at + 1
            out.append(piece)
        text = re.sub(r"\^([0-9+\-=])", lambda m: RAISED[m[1]], "".join(out))
        return _tidy(re.sub(r"_([0-9+\-=])", lambda m: LOWERED[m[1]], text))


def formula_text(latex: str | None) -> str | None:
    """Readable one-line text of a formula; null of null. `\\frac{a}{b}` is (a)/(b), arguments may lack braces (`\\tfrac12`, `\\hat z`),
    a digit or sign behind ^ or _ is raised or lowered, and commands that are not known stay as they are written."""
    if latex is None:
        return None
    text = re.sub(r"(?m)(?<!\\)%.*$", "", latex)
    return _Reader(text).span(0, len(text))


def readable(x: Column) -> Column:
    f: Callable = lambda s: s.map(formula_text, na_action="ignore")
    return F.pandas_udf(f, "string")(x)
