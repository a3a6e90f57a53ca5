"""Chemical formulas as Spark SQL expressions; everything stays on the JVM.

The builders take and return SQL text, so that a whole expression reaches the session as one string and is analysed
once. A composition is ``array<struct<el string, n double>>`` with distinct elements in order of first appearance;
null stands for a formula that is null or not well formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS_TYPE = "array<struct<el:string,n:double>>"
STATE_TYPE = f"struct<stack:array<double>,parts:{PARTS_TYPE},ok:boolean>"
ELEMENT = "[A-Z][a-z]*"
FLAT_FORMULA = "^([A-Z][a-z]*([0-9]+([.][0-9]*)?|[.][0-9]+)?)+$"
TOKEN = "[(\\[{]|[)\\]}][0-9.]*|[A-Z][a-z]*[0-9.]*"
OPENING, CLOSING = "^[(\\[{]", "^[)\\]}]"
# The symbols of all elements, by atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb "
    "Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au "
    "Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
# Amounts at or below this are dropped, so that Co0 leaves no cobalt behind.
ZERO_AMOUNT = 1e-8


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column name as SQL, whatever characters it has."""
    return "`" + column.strip("`") + "`"


def texts(values: list[str]) -> str:
    """A SQL array of string literals."""
    return "array(" + ", ".join(text(v) for v in values) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _entry(el: str, n: str) -> str:
    return f"named_struct('el', {el}, 'n', {n})"


def _amount(written: str) -> str:
    """Amount written after a symbol or bracket; nothing written means one."""
    return f"if({written} = '', 1D, try_cast({written} as double))"


def _flat_parts(formula: str) -> str:
    found = lambda group: f"regexp_extract_all({formula}, '({ELEMENT})([0-9.]*)', {group})"
    return f"zip_with({found(1)}, {found(2)}, (s, a) -> {_entry('s', _amount('a'))})"


def _bracketed_parts(formula: str) -> str:
    """Parts of a bracketed formula, read right to left with a stack of multipliers.

    A closing bracket pushes the multiplier in force inside it, an opening bracket pops it; an unbalanced formula
    or leftover text gives null.
    """
    number = let("w", "regexp_extract(token, '([0-9.]*)$', 1)", _amount("w"))
    step = f"""cast(case
        when token rlike {text(CLOSING)} then
            struct(array_prepend(acc.stack, get(acc.stack, 0) * {number}) as stack, acc.parts as parts, acc.ok as ok)
        when token rlike {text(OPENING)} then
            struct(slice(acc.stack, 2, size(acc.stack)) as stack, acc.parts as parts,
                   acc.ok and size(acc.stack) > 1 as ok)
        else
            struct(acc.stack as stack,
                   array_prepend(acc.parts, {_entry(f"regexp_extract(token, '^({ELEMENT})', 1)", f"get(acc.stack, 0) * {number}")})
                       as parts,
                   acc.ok as ok)
        end as {STATE_TYPE})"""
    start = f"cast(struct(array(1D) as stack, cast(array() as {PARTS_TYPE}) as parts, array_join(ts, '') = {formula} as ok) as {STATE_TYPE})"
    done = "if(acc.ok and size(acc.stack) = 1, acc.parts, null)"
    read = f"aggregate(reverse(ts), {start}, (acc, token) -> {step}, acc -> {done})"
    return let("ts", f"regexp_extract_all({formula}, {text('(' + TOKEN + ')')}, 1)", read)


def parse_parts(formula: str) -> str:
    """Composition of a formula: repeats summed, no amount means one, vanishing amounts dropped.

    A symbol that no element has makes the formula unreadable. Plain formulas take the short path; only formulas with
    brackets are read with the stack.
    """
    raw = f"""case when t rlike {text(FLAT_FORMULA)} then {_flat_parts('t')}
                   when t rlike {text('[(\\[{]')} then {_bracketed_parts('t')} end"""
    total = "aggregate(filter(r, p -> p.el = s), 0D, (sum, p) -> sum + p.n)"
    merged = let(
        "symbols",
        "array_distinct(transform(r, p -> p.el))",
        f"if(size(symbols) = size(r), r, transform(symbols, s -> {_entry('s', total)}))",
    )
    unread = f"p -> p.n is null or not array_contains({texts(SYMBOLS)}, p.el)"
    whole = f"if(r is null or exists(r, {unread}), null, filter({merged}, p -> abs(p.n) > {ZERO_AMOUNT}D))"
    return let("t", f"translate({formula}, ' ', '')", let("r", raw, whole))


def parts_map(parts: str) -> str:
    """The composition as ``map<string, double>``."""
    return f"map_from_entries({parts})"


def radix(parts: str) -> str:
    """Number of distinct elements; null for a formula that cannot be read."""
    return f"if({parts} is null, null, size({parts}))"


def stoichiometry(parts: str, symbols: list[str], amounts: str = "int") -> str:
    """Non-zero amounts of the known elements.

    ``amounts='int'`` truncates amounts to whole numbers before anything else is derived from them (so
    ``Fe0.5Co0.5`` becomes empty); ``'exact'`` keeps decimals.
    """
    if amounts not in ("int", "exact"):
        raise ValueError("amounts must be 'int' or 'exact'")
    known = f"filter({parts}, p -> array_contains({texts(symbols)}, p.el))"
    if amounts == "int":
        known = f"transform({known}, p -> {_entry('p.el', 'cast(cast(p.n as bigint) as double)')})"
    return f"filter({known}, p -> p.n <> 0)"


def fractions(stoich: str) -> str:
    """Atomic fractions ``n / sum(n)``; empty when there is nothing to divide."""
    shares = f"transform(st, p -> {_entry('p.el', 'p.n / total')})"
    body = let("total", "aggregate(st, 0D, (sum, p) -> sum + p.n)", f"if(total = 0, cast(array() as {PARTS_TYPE}), {shares})")
    return let("st", stoich, body)


def with_parts(df: DataFrame, formula: str = "formula", out: str = "parts") -> DataFrame:
    """Add the parsed composition.

    The array goes through ``explode`` of a one-element array: a generator stops the optimizer from folding the
    parser into every later reference, so each formula is parsed once.
    """
    return df.select("*", F.expr(f"explode(array({parse_parts(name(formula))})) as {out}"))


def contains_element(formula: str, symbol: str) -> str:
    """Substring test used to group formulas by element."""
    return f"contains({formula}, {text(symbol)})"


def symbol_tokens(formula: str) -> str:
    """Element symbols as written, repeats kept; needs no well-formed formula."""
    return f"regexp_extract_all({formula}, '({ELEMENT})', 1)"


def mentions_any(formula: str, symbols: list[str]) -> str:
    """Whether a formula mentions one of the elements."""
    return f"arrays_overlap({symbol_tokens(formula)}, {texts(symbols)})"
