"""Symbols in LaTeX: tokens, definitions, keys and roles, by regular expressions over the distinct formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPTS = r"(?:_\{[^{}]*\}|_[A-Za-z0-9]+|\^\{[^{}]*\}|\^[A-Za-z0-9]+)*"
#: Styles that make one symbol with what they stand over or around.
ACCENTS = ["bar", "overline", "hat", "widehat", "tilde", "widetilde", "dot", "vec", "mathbf", "boldsymbol"]
#: Fixed value: a symbol is a styled group, a macro or a letter, with its scripts.
TOKEN = rf"\\(?:{'|'.join(ACCENTS)})\{{[^{{}}]+\}}{SCRIPTS}|\\[A-Za-z]+{SCRIPTS}|[A-Za-z]{SCRIPTS}"
#: Macros that name operators.
OPERATORS = "Pr P E Var Cov cov corr det exp log ln max min".split()
#: Macros of Greek letters.
GREEK = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho varrho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega"
).split()
#: Macros of style.
STYLES = "bar overline hat widehat tilde widetilde dot vec mathbf boldsymbol mathbb mathcal mathscr mathrm mathit mathsf operatorname".split()
#: Macros of layout, sums, relations and dots.
NO_SYMBOLS = (
    "frac dfrac tfrac sqrt sum prod int iint iiint left right big Big bigg Bigg begin end limits nolimits binom choose cdot times pm mp le leq ge geq neq approx simeq sim propto "
    "to rightarrow leftarrow leftrightarrow infty ldots cdots dots qquad quad lim mid text"
).split()
OPEN = r"\s*(?:\\left)?\s*[(\[]"
#: A left side up to the first ``=`` outside braces, which nest up to four deep.
LEFT = r"^((?:[^{}=\\]++|\\.|\{(?:[^{}]++|\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*\})*\})*\})*\})*+)="
OPERATOR_CALL = rf"^\s*(?:\\sigma{OPEN}.*,.*[)\]]\s*$|(?:E|\\?(?:Pr|Var|Cov|cov|corr|det|ln|log|exp)){OPEN})"


def tokens(latex: Column) -> Column:
    """Distinct symbols of a formula in order of first place, without operators, layout and letters that name operators before a parenthesis."""
    clean = F.regexp_replace(F.regexp_replace(latex, r"\\(?:begin|end)\s*\{[^{}]*\}", " "), r"\\\\+", " ")
    clean = F.regexp_replace(clean, r"\\(?:operatorname|mathrm|text)\s*\{[A-Za-z ]{2,}\}", " ")
    clean = F.regexp_replace(clean, rf"(?<![A-Za-z\\])(?:E|P|Pr|Var|Cov)(?={OPEN})", " ")
    none = F.array(*map(F.lit, [*OPERATORS, *NO_SYMBOLS, *STYLES]))
    styled = rf"^\\(?:{'|'.join(ACCENTS)})\{{"
    return F.filter(F.array_distinct(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))), lambda x: x.rlike(styled) | ~F.array_contains(none, F.regexp_extract(x, r"^\\([A-Za-z]+)", 1)))


def symbol_occurrences(formulas: DataFrame) -> DataFrame:
    """(formula_id, symbol, ordinal) of formulas(formula_id, latex): distinct tokens in order of first place, without operators."""
    d = formulas.select("formula_id", F.posexplode_outer(tokens(F.col("latex"))).alias("ordinal", "symbol")).filter("symbol is not null")
    return d.select("formula_id", "symbol", F.col("ordinal").cast("long").alias("ordinal"))


def left_side(latex: Column) -> tuple[Column, Column]:
    """The symbols that the left side of a formula defines, and whether it is the call of an operator."""
    left = F.regexp_extract(latex, LEFT, 1)
    call = left.rlike(OPERATOR_CALL)
    inner = F.regexp_extract(left, rf"^\s*E{OPEN}(.*)(?:\\right)?[)\]]\s*$", 1)
    one = call & (inner != "") & ~inner.rlike(r",|\||\\mid\b")
    return F.when(call & ~one, F.array().cast("array<string>")).otherwise(tokens(F.when(one, inner).otherwise(left))), call


def defined_symbols(formulas: DataFrame, occ: DataFrame) -> DataFrame:
    """(formula_id, symbol, kind): symbols left of the first ``=`` outside braces are defined; without any there, the leftmost one.

    A call of an operator on the left defines nothing, but for E(x) of one argument, which defines its symbols.
    """
    lhs, call = left_side(F.col("latex"))
    d = occ.join(formulas.select("formula_id", lhs.alias("lhs"), call.alias("call")), "formula_id")
    defined = F.when((F.size("lhs") > 0) | F.col("call"), F.array_contains("lhs", F.col("symbol"))).otherwise(F.col("ordinal") == 0)
    return d.select("formula_id", "symbol", F.when(defined, "defined").otherwise("used").alias("kind"))


def fragment_suppression(occ: DataFrame, formulas: DataFrame | None = None) -> DataFrame:
    """Occurrences without plain symbols that have an indexed form in the same formula; with ``formulas`` also without a bare sigma that is called on two arguments.

    Tokens take their scripts along, so a piece of a compound symbol is listed only where it stands alone, and stays.
    """
    indexed = occ.filter(F.instr("symbol", "_") > 0).select("formula_id", F.substring_index("symbol", "_", 1).alias("symbol")).distinct()
    out = occ.join(indexed, ["formula_id", "symbol"], "left_anti")
    if formulas is None:
        return out
    called = formulas.filter(F.col("latex").rlike(rf"\\sigma{OPEN}[^()\[\]]*,")).select("formula_id", F.lit("\\sigma").alias("symbol"))
    return out.join(called, ["formula_id", "symbol"], "left_anti")


def whole_lists(formulas: DataFrame) -> DataFrame:
    """X3 of formulas(formula_id, latex) as lists: (formula_id, latex, whole), the whole symbols of each formula (symbol, ordinal); nothing moves."""
    d = formulas.select("formula_id", "latex", tokens(F.col("latex")).alias("t"))
    plain = F.transform(F.filter("t", lambda x: F.instr(x, "_") > 0), lambda x: F.substring_index(x, "_", 1))
    called = F.coalesce(F.col("latex").rlike(rf"\\sigma{OPEN}[^()\[\]]*,"), F.lit(False))
    d = d.select("formula_id", "latex", F.transform("t", lambda x, i: F.struct(x.alias("symbol"), i.cast("long").alias("ordinal"))).alias("t"), plain.alias("plain"), called.alias("called"))
    whole = F.filter("t", lambda x: ~F.array_contains("plain", x["symbol"]) & ~(F.col("called") & (x["symbol"] == "\\sigma")))
    return d.select("formula_id", "latex", whole.alias("whole"))


def whole_symbols(formulas: DataFrame) -> DataFrame:
    """X3 of formulas(formula_id, latex): (formula_id, symbol, ordinal), what ``fragment_suppression`` gives for their occurrences."""
    # outer, as Spark would else make the lists twice: once to see whether they are empty
    return whole_lists(formulas).select("formula_id", F.inline_outer("whole")).filter("symbol is not null")


def symbol_keys(symbols: DataFrame) -> DataFrame:
    """Distinct symbols with canonical, family, base, subscript, superscript, accent."""
    s = F.regexp_replace(F.regexp_replace("symbol", r"\s+", ""), r"\\(?:left|right)", "")
    for old, new in (("bar", "overline"), ("widehat", "hat"), ("widetilde", "tilde")):
        s = F.regexp_replace(s, rf"\\{old}\b", rf"\\{new}")
    s = F.regexp_replace(s, r"([_^])\{([^{}]*)\}", "$1$2")
    d = symbols.select("symbol").distinct().withColumn("canonical", s)
    bare = d["canonical"]
    for style in STYLES:
        bare = F.regexp_replace(bare, rf"\\{style}(?![A-Za-z])", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[_^](?:\{[^{}]*\}|\\?[A-Za-z0-9]+)", ""), r"[(){}]", "")
    part = lambda p: F.regexp_extract("canonical", p, 1)
    return d.withColumns({"family": F.when(bare != "", bare).otherwise(F.col("canonical")), "base": part(r"^([^_^]*)"), "subscript": part(r"_([^^]*)"), "superscript": part(r"\^(.*)$"), "accent": part(rf"^\\({'|'.join(STYLES)})\{{")})


def symbol_role(keys: DataFrame) -> DataFrame:
    """Keys with role and is_operator."""
    c, macro = F.col("canonical"), F.regexp_extract("canonical", r"^\\([A-Za-z]+)", 1)
    operator = macro.isin(OPERATORS) | c.isin("E", "P", "Pr", "Var", "Cov")
    role = (
        F.when(c.rlike(r"^\\sigma\([^)]*,"), "covariance_operator").when((macro == "sigma") & c.rlike(r"\^2"), "statistic_variance").when(c.rlike(r"^\\(?:mathbf|boldsymbol)\{?\\?Sigma"), "matrix_symbol")
        .when(macro.isin(OPERATORS), "operator").when(macro.isin(GREEK) & (F.col("canonical") == F.concat(F.lit("\\"), macro)), "variable").when(c.rlike(r"^[A-Za-z]+_[A-Za-z0-9]+$"), "parameter").when(c.rlike("^[A-Za-z]$"), "variable").otherwise("symbol")
    )
    return keys.withColumns({"role": role, "is_operator": operator})


def concept_symbols(formulas: DataFrame) -> DataFrame:
    """(formula_id, symbol, role): whole symbols only, the first left of ``=`` as defined, the rest of the right side as used; a symbol on both sides is defined."""
    lhs, call = left_side(F.col("latex"))
    d = whole_lists(formulas).select("formula_id", "whole", lhs.alias("lhs"), call.alias("call"))
    defined = F.filter("whole", lambda x: F.when((F.size("lhs") > 0) | F.col("call"), F.array_contains("lhs", x["symbol"])).otherwise(x["ordinal"] == 0))
    d = d.select("formula_id", F.get(defined, F.lit(0))["symbol"].alias("_first"), F.inline_outer("whole")).filter("symbol is not null")
    return d.select("formula_id", "symbol", F.when(F.col("symbol") == F.col("_first"), "defined").otherwise("used").alias("role"))
