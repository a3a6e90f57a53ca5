"""Checking SQL for the catalogue, in the explode-and-join form and over all rows.

The texts share common table expressions; :func:`sql` puts in front of a query those it needs.
"""

from __future__ import annotations

import re

from lodespark.operators.cases import LITERATURE, MINOR, SERIES
from lodespark.operators.cleaning import NON_COMMERCIAL, RARE_EARTHS, TESLA_PER_BOHR_DENSITY
from lodespark.operators.features import FEATURES
from lodespark.plans.fixtures import fixture_sql
from lodespark.sources.dimensions import ELEMENT_SCHEMA, SAMPLE_ELEMENTS


def _values(rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        if isinstance(v, str):
            return "'" + v + "'"
        return f"{v!r}::double" if isinstance(v, float) else str(v)

    return "values " + ",".join("(" + ",".join(cell(v) for v in r) + ")" for r in rows)


def _tokens(source: str, column: str = "formula") -> str:
    pattern = "'([A-Z][a-z]*)([0-9.]*)'"
    return f"""select formula, el, sum(case when n = '' then 1 else n::double end) as n from (
        select {column} as formula, unnest(regexp_extract_all({column}, {pattern}, 1)) as el,
               unnest(regexp_extract_all({column}, {pattern}, 2)) as n
        from (select distinct {column} from {source} where {column} is not null)) group by all having n > 1e-8"""


def _features(source: str) -> str:
    """Features of every distinct formula of a (formula, ms) source, straight from the definition."""
    return f"""
    {source}_parts as ({_tokens(source)}),
    {source}_int as (select p.formula, p.el, trunc(p.n) as n from {source}_parts p join elements e on e.symbol = p.el
                     where trunc(p.n) <> 0),
    {source}_frac as (select formula, el, n / sum(n) over (partition by formula) as af from {source}_int),
    {source}_single as (
        select f.formula, -sum(af * ln(af)) + 0.0 as stoicentw,
               case when count(en) = count(*) then sum(af * en) end as electronegw,
               case when count(weight) = count(*) then sum(af * weight) end as Zw,
               sum(af * grp) / sum(case when grp is not null then af end) as groupw,
               case when count(period) = count(*) then sum(af * period) end as periodw,
               case when count(melting_point) = count(*) then sum(af * melting_point) end as meltingTw,
               case when count(valence) = count(*) then sum(af * valence) end as valencew
        from {source}_frac f join properties e on e.symbol = f.el group by f.formula),
    {source}_pair as (
        select l.formula, case when count(h) = count(*) then sum(4 * l.af * r.af * h) end as miedemaH
        from {source}_frac l join {source}_frac r on l.formula = r.formula and l.el < r.el
        left join pairs p on p.a = l.el and p.b = r.el group by l.formula),
    {source}_radix as (select formula, count(*)::double as compoundradix from {source}_parts group by formula),
    {source}_distinct as (
        select r.formula, compoundradix, stoicentw, Zw, periodw, groupw, meltingTw,
               case when p.formula is null then 0 else miedemaH end as miedemaH, valencew, electronegw
        from {source}_radix r join {source}_single using (formula) left join {source}_pair p using (formula))"""


def _table(source: str) -> str:
    medians = ", ".join(f"median({f}) as {f}" for f in FEATURES)
    complete = " and ".join(f"{f} is not null" for f in FEATURES)
    return f"""select formula, median(ms) as ms, {medians} from {source} join {source}_distinct using (formula)
        where ms is not null and {complete} and ms >= 0.18::double group by formula"""


def _contains(column: str, symbols: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{s}')" for s in symbols) + ")"


_CTES: dict[str, str] = {name: f"{name} as ({fixture_sql(name)})" for name in
                         ("compounds", "exports", "documents_json", "predictions")}
_CTES |= {
    "elements": f"elements({', '.join(ELEMENT_SCHEMA.names)}) as ({_values(SAMPLE_ELEMENTS)})",
    "properties": """properties as (select symbol, nullif(regexp_extract(electronegativity, '\\d*\\.\\d+'), '')::double as en,
        atomic_weight as weight, nullif(regexp_extract(group_block, '\\d+'), '')::double as grp, period, melting_point,
        valence from elements)""",
    "pairs": """pairs as (select l.symbol as a, r.symbol as b, 2 - 10 * (l.en - r.en) ** 2 as h
        from properties l join properties r on l.symbol < r.symbol where not (l.symbol = 'Sm' and r.symbol = 'Zr'))""",
    "good": "good as (select * from documents_json where json_valid(doc))",
    "cleaned": f"""cleaned as (select composition as formula,
        try_cast(total_magnetization_normalized_vol as double) * {TESLA_PER_BOHR_DENSITY!r}::double as ms from exports
        where is_magnetic and not {_contains('composition', RARE_EARTHS + NON_COMMERCIAL)})""",
    "compounds_features": _features("compounds"),
    "cleaned_features": _features("cleaned"),
    "feat": f"feat as ({_table('compounds')})",
    "feat_cleaned": f"feat_cleaned as ({_table('cleaned')})",
    "holdout": """holdout as (select *, row_number() over (order by md5(concat(formula, '#', 0)), formula) - 1
        < floor(0.8::double * count(*) over ()) as is_train from feat)""",
    "grouped": """grouped as (select g as grp, ms as value from compounds, unnest(['all', 'Fe', 'Co', 'Cr', 'Mn']) as t(g)
        where ms is not null and (g = 'all' or contains(formula, g)))""",
    "folds_metrics": """folds_metrics as (select model, fold, avg((y - yhat) ** 2) as mse, avg(abs(y - yhat)) as mae,
        avg(abs(y - yhat) / (abs(y) + 1e-8)) as mre, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) as r2
        from predictions group by model, fold)""",
    "diffs": """diffs as (select metric, fold, max(case when model = 'a' then v end) - max(case when model = 'b' then v end) as d
        from (unpivot folds_metrics on mse, mae, mre, r2 into name metric value v) group by metric, fold)""",
}
_NEEDS = {
    "properties": ["elements"],
    "pairs": ["properties"],
    "good": ["documents_json"],
    "cleaned": ["exports"],
    "compounds_features": ["compounds", "elements", "properties", "pairs"],
    "cleaned_features": ["cleaned", "elements", "properties", "pairs"],
    "feat": ["compounds_features"],
    "feat_cleaned": ["cleaned_features"],
    "holdout": ["feat"],
    "grouped": ["compounds"],
    "folds_metrics": ["predictions"],
    "diffs": ["folds_metrics"],
}


def sql(body: str, needs: list[str], extra: list[str] | None = None, digits: list[str] | None = None) -> str:
    """A full query: the tables it needs, its own ones, and the named doubles rounded."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    ctes = [_CTES[n] for n in order] + (extra or [])
    if digits:
        rounded = ", ".join(f"round({d} + 1e-9, 6) + 0.0 as {d}" for d in digits)
        body = f"select * replace ({rounded}) from ({body})"
    text = f"with {', '.join(ctes)} {body}" if ctes else body
    return re.sub(r"\s+", " ", text).strip()


def plane_fit(source: str, name: str, alpha: float = 0.0, x1: str = "valencew", x2: str = "electronegw") -> list[str]:
    """Closed-form (ridge) regression of ms on two features, as tables ending in ``name(w1, w2, b)``."""
    return [
        f"{name}_m as (select avg({x1}) as m1, avg({x2}) as m2, avg(ms) as my from {source})",
        f"""{name}_s as (select sum(({x1} - m1) ** 2) + {alpha} as s11, sum(({x1} - m1) * ({x2} - m2)) as s12,
            sum(({x2} - m2) ** 2) + {alpha} as s22, sum(({x1} - m1) * (ms - my)) as s1y,
            sum(({x2} - m2) * (ms - my)) as s2y from {source}, {name}_m)""",
        f"""{name}_w as (select (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as w1,
            (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as w2 from {name}_s)""",
        f"{name} as (select w1, w2, my - w1 * m1 - w2 * m2 as b from {name}_w, {name}_m)",
    ]


def slope(l1: str, l2: str) -> str:
    """Slope of an elastic net on one feature from centred mean products ``cxx`` and ``cxy``."""
    return f"sign(cxy) * greatest(abs(cxy) - ({l1}), 0) / (cxx + ({l2}))"


def series_table() -> str:
    """The series' formulas with system and minor element."""
    rows = [(s, f, MINOR[s]) for s, fs in SERIES.items() for f in fs]
    return f"series(system, formula, minor) as ({_values(rows)})"


def literature_table() -> str:
    rows = [(s, x, v) for s, points in LITERATURE.items() for x, v in points]
    return f"literature(system, x, value) as ({_values(rows)})"


def series_features() -> list[str]:
    """Features of the series' formulas with the minor-element fraction."""
    return [
        series_table(),
        _features("series").strip(),
        """series_x as (select s.system, s.formula, f.af as x, d.* exclude (formula) from series s
           join series_distinct d using (formula) left join series_frac f on f.formula = s.formula and f.el = s.minor)""",
    ]
