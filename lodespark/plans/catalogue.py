"""The query catalogue: every operator on the driver tables, with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import formula as fx
from lodespark.operators import attribution, cases, cleaning, composition, distributions, metrics, significance
from lodespark.operators import splits, tuning
from lodespark.operators.features import FEATURES, build_features, drop_missing, featurise, magnetic_cutoff
from lodespark.operators.regressors import MODELS, fit_boosted, fit_forest, fit_model, predict
from lodespark.operators.tree_tables import cut_trees, node_table, score_by_joins, split_checks
from lodespark.plans import oracle as o
from lodespark.plans.fixtures import fixture
from lodespark.session import scratch_path, sized
from lodespark.sources import dimensions, documents, tabular

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    oracle: str | None


CATALOGUE: dict[str, Entry] = {}
PLANE = ["valencew", "electronegw"]
SEEDS = [0, 5, 10, 15, 20]


def entry(name: str, body: str | None = None, needs: list[str] | None = None, extra=None, digits=None):
    """Register a query and its checking SQL; doubles named in ``digits`` are rounded on both sides."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits) if digits else fn(spark, sf_dir)

        text = o.sql(body, needs or [], extra, digits) if body else None
        CATALOGUE[name] = Entry(run, text)
        return fn

    return register


def rounded(df: DataFrame, digits: list[str]) -> DataFrame:
    """Six digits for comparison; the small shift keeps values that end in a 5 from rounding either way."""
    return df.select(*[(F.round(F.col(c) + F.lit(1e-9), 6) + F.lit(0.0)).alias(c) if c in digits else F.col(f"`{c}`") for c in df.columns])


_DIMS: dict[str, tuple[DataFrame, DataFrame]] = {}


def _dims(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The sample dimensions, planned once per session."""
    app = spark.sparkContext.applicationId
    if app not in _DIMS:
        _DIMS[app] = dimensions.sample_elements(spark), dimensions.sample_pairs(spark)
    return _DIMS[app]


def _table(spark: SparkSession, sf: str, source: str = "compounds") -> DataFrame:
    raw = fixture(spark, sf, "compounds") if source == "compounds" else cleaning.clean_export(fixture(spark, sf, "exports"))
    return build_features(raw, *_dims(spark))


def _formulas(spark: SparkSession, sf: str) -> DataFrame:
    return composition.formula_counts(fixture(spark, sf, "compounds")).select("formula")


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table, kept because model queries go over it more than once."""
    return _table(spark, sf).persist()


def _holdout(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, kept for the same reason."""
    split = splits.holdout_split(_kept(spark, sf)).persist()
    return split.where("is_train"), split.where("not is_train")


def _fitted(spark: SparkSession, sf: str, key: str, params: dict | None = None) -> Any:
    return fit_model(key, _holdout(spark, sf)[0], FEATURES, params=params)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.parse_documents(fixture(spark, sf, "documents_json"), "doc", ["k", "ln"])


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return documents.flatten_documents(_docs(spark, sf), ["k", "ln"])


def _leaf(section: str, key: str) -> str:
    """Checking SQL for a leaf: an object whose only key is value stands for that value."""
    node = f"(doc->'$.properties.{section}.\"{key}\"')"
    wrapped = f"json_type({node}) = 'OBJECT' and len(json_keys({node})) = 1 and json_keys({node})[1] = 'value'"
    return f"case when {wrapped} then {node}->>'$.value' else {node}->>'$' end"


# --- sources and sinks


@entry(
    "a1_property_rows",
    f"""select k, ln, nullif({_leaf('chemistry', 'chemical formula')}, 'none') as formula,
       (doc->>'$.properties.crystal."compound space group".value')::int as space_group,
       (doc->>'$.properties.crystal."lattice parameters".value[0]')::double as lattice_a,
       (doc->>'$.properties.magnetics."saturation magnetization".value')::double as ms from good""",
    ["good"],
    digits=["lattice_a", "ms"],
)
def a1(spark, sf):
    rows = documents.retype(documents.normalise_null_literals(_flat(spark, sf)))
    return rows.select(
        "k",
        "ln",
        F.col("chemical formula").alias("formula"),
        F.col("compound space group").alias("space_group"),
        F.get("lattice parameters", F.lit(0)).alias("lattice_a"),
        F.col("saturation magnetization").alias("ms"),
    )


@entry(
    "a2_quarantine",
    """select case when json_valid(doc) then 'good' else 'malformed' end as status, count(*) as n,
       count(distinct k) as n_orders from documents_json group by 1""",
    ["documents_json"],
)
def a2(spark, sf):
    docs = _docs(spark, sf)
    counted = documents.document_status(docs).groupBy("status")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("n_orders"))


_TC = "doc->'$.properties.magnetics.\"curie temperature\"'"


@entry(
    "a3_unwrap_values",
    f"""select k, ln, case when len(json_keys({_TC})) = 1 then {_TC}->>'$.value' else ({_TC})::varchar end as value
        from good""",
    ["good"],
)
def a3(spark, sf):
    rows = documents.flatten_documents(_docs(spark, sf), ["k", "ln"])
    return rows.select("k", "ln", F.col("curie temperature").alias("value"))


@entry(
    "a4_merge_sections",
    """select k, ln, len(list_distinct(list_concat(list_concat(json_keys(doc->'$.properties.chemistry'),
         json_keys(doc->'$.properties.crystal')), json_keys(doc->'$.properties.magnetics'))))::bigint as n_keys,
       (case when list_contains(json_keys(doc->'$.properties.magnetics'), 'magnetic order')
             then doc->'$.properties.magnetics."magnetic order"'
             else doc->'$.properties.chemistry."magnetic order"' end)::varchar as magnetic_order from good""",
    ["good"],
)
def a4(spark, sf):
    return documents.merged_documents(_docs(spark, sf), ["k", "ln"]).select(
        "k",
        "ln",
        F.size("leaves").cast("bigint").alias("n_keys"),
        F.try_element_at("leaves", F.lit("magnetic order")).alias("magnetic_order"),
    )


@entry("a5_csv_scan", "select * from exports", ["exports"])
def a5(spark, sf):
    path = scratch_path(spark, "exports-csv")
    tabular.write_table(fixture(spark, sf, "exports"), path)
    return tabular.read_table(spark, path, tabular.EXPORT_SCHEMA)


@entry(
    "a6_element_dimension",
    """select symbol, en, weight, grp, period, melting_point, valence from properties where symbol in
       (select unnest(regexp_extract_all(formula, '[A-Z][a-z]*')) from (select distinct formula from compounds))""",
    ["compounds", "properties"],
)
def a6(spark, sf):
    seen = _formulas(spark, sf).select(F.expr(f"explode({fx.symbol_tokens('formula')}) as symbol")).distinct()
    # Written with another column order and more columns than the dimension has.
    path = scratch_path(spark, "elements-csv")
    sample = dimensions.sample_elements(spark)
    columns = [F.lit(1).alias("atomic_number"), *reversed(sample.columns), F.lit("x").alias("remark")]
    sample.select(*columns).write.option("header", True).csv(path)
    elements = dimensions.read_elements(spark, path)
    return elements.join(seen, "symbol", "left_semi").select(
        "symbol",
        dimensions.electronegativity_value(F.col("electronegativity")).alias("en"),
        F.col("atomic_weight").alias("weight"),
        dimensions.group_number(F.col("group_block")).alias("grp"),
        "period",
        "melting_point",
        "valence",
    )


@entry(
    "a7_pair_matrix",
    "select a, b, sum(h) as h from (select a, b, h from cells union all select b, a, h from cells) group by a, b",
    [],
    [
        """filled as (select concat('e', l_partkey % 6) as a, concat('e', l_suppkey % 6) as b, sum(l_quantity) as h from lineitem
           where l_partkey % 6 <= l_suppkey % 6 group by 1, 2)""",
        """cells as (select concat('e', i) as a, concat('e', j) as b, coalesce(h, 0) as h from range(6) x(i), range(6) y(j)
           left join filled f on f.a = concat('e', i) and f.b = concat('e', j))""",
    ],
    digits=["h"],
)
def a7(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    labels = [f"e{i}" for i in range(6)]
    label = lambda c: F.concat(F.lit("e"), (F.col(c) % 6).cast("string"))
    upper = lineitem.where("l_partkey % 6 <= l_suppkey % 6")
    wide = (
        upper.select(label("l_partkey").alias("element"), label("l_suppkey").alias("other"), "l_quantity")
        .groupBy("element")
        .pivot("other", labels)
        .sum("l_quantity")
    )
    path = scratch_path(spark, "pairs-csv")
    wide.select(*labels[3:], "element", *labels[:3]).write.option("header", True).csv(path)
    return dimensions.read_pair_matrix(spark, path)


_FEATURE_TABLE = ("select * from feat", ["feat"])
_TABLE_DIGITS = ["ms", *FEATURES]


@entry("a8_feature_sink", *_FEATURE_TABLE, digits=_TABLE_DIGITS)
def a8(spark, sf):
    path = scratch_path(spark, "features-csv")
    tabular.write_table(_table(spark, sf), path)
    return tabular.read_table(spark, path, tabular.feature_schema())


# --- cleaning


@entry(
    "b1_null_literals",
    f"""select k, ln, case when f not in ('none', 'None') then f end as formula, case when t not in ('none', 'None') then t end as tc
       from (select k, ln, {_leaf('chemistry', 'chemical formula')} as f, {_leaf('magnetics', 'curie temperature')} as t from good)""",
    ["good"],
)
def b1(spark, sf):
    rows = documents.normalise_null_literals(_flat(spark, sf))
    return rows.select("k", "ln", F.col("chemical formula").alias("formula"), F.col("curie temperature").alias("tc"))


@entry(
    "b2_retype",
    f"""select k, ln, try_cast({_leaf('magnetics', 'curie temperature')} as double) as tc,
       try_cast(doc->>'$.properties.crystal."compound space group".value' as int) as space_group from good""",
    ["good"],
    digits=["tc"],
)
def b2(spark, sf):
    rows = documents.retype(documents.normalise_null_literals(_flat(spark, sf)))
    return rows.select(
        "k", "ln", F.col("curie temperature").alias("tc"), F.col("compound space group").alias("space_group")
    )


@entry(
    "b3_rename",
    "select composition as formula, total_magnetization_normalized_vol, is_magnetic from exports",
    ["exports"],
)
def b3(spark, sf):
    return cleaning.rename_formula(fixture(spark, sf, "exports"))


@entry(
    "b4_numeric_coercion",
    "select composition, try_cast(total_magnetization_normalized_vol as double) as moment from exports",
    ["exports"],
    digits=["moment"],
)
def b4(spark, sf):
    moment = cleaning.lenient_double(F.col("total_magnetization_normalized_vol"))
    return fixture(spark, sf, "exports").select("composition", moment.alias("moment"))


@entry(
    "b5_unit_conversion",
    f"""select composition, try_cast(total_magnetization_normalized_vol as double) * {cleaning.TESLA_PER_BOHR_DENSITY!r}::double
        as ms from exports""",
    ["exports"],
    digits=["ms"],
)
def b5(spark, sf):
    moment = cleaning.lenient_double(F.col("total_magnetization_normalized_vol"))
    return fixture(spark, sf, "exports").select("composition", cleaning.to_tesla(moment).alias("ms"))


@entry("b6_magnetic_filter", "select * from exports where is_magnetic", ["exports"])
def b6(spark, sf):
    return cleaning.keep_magnetic(fixture(spark, sf, "exports"))


@entry(
    "b7_rare_earth_exclusion",
    f"select composition, is_magnetic from exports where not {o._contains('composition', cleaning.RARE_EARTHS)}",
    ["exports"],
)
def b7(spark, sf):
    rows = fixture(spark, sf, "exports").select("composition", "is_magnetic")
    return cleaning.exclude_elements(rows, cleaning.RARE_EARTHS, "composition")


@entry(
    "b8_non_commercial_exclusion",
    f"select composition, is_magnetic from exports where not {o._contains('composition', cleaning.NON_COMMERCIAL)}",
    ["exports"],
)
def b8(spark, sf):
    rows = fixture(spark, sf, "exports").select("composition", "is_magnetic")
    return cleaning.exclude_elements(rows, cleaning.NON_COMMERCIAL, "composition")


@entry(
    "b9_cleaning_audit",
    """select step_no, step, n_rows, coalesce(lag(n_rows) over (order by step_no) - n_rows, 0) as n_dropped from (
         select 0::bigint as step_no, 'initial' as step, count(*) as n_rows from exports union all
         select 1, 'magnetic', count(*) from exports where is_magnetic union all
         select 2, 'without_rare_earth', count(*) from exports where is_magnetic and not """
    + o._contains("composition", cleaning.RARE_EARTHS)
    + " union all select 3, 'without_non_commercial', count(*) from cleaned)",
    ["cleaned"],
)
def b9(spark, sf):
    return cleaning.cleaning_audit(fixture(spark, sf, "exports"))


@entry("b10_projection", "select * from cleaned", ["cleaned"], digits=["ms"])
def b10(spark, sf):
    return cleaning.clean_export(fixture(spark, sf, "exports"))


@entry(
    "b11_missing_drop",
    "select formula, max(ms) as ms from compounds join compounds_distinct using (formula) where "
    + " and ".join(f"{f} is not null" for f in FEATURES)
    + " group by formula having max(ms) is not null",
    ["compounds_features"],
    digits=["ms"],
)
def b11(spark, sf):
    best = fixture(spark, sf, "compounds").groupBy("formula").agg(F.max("ms").alias("ms"))
    return drop_missing(featurise(best, *_dims(spark), carry=["ms"]), "ms").select("formula", "ms")


@entry("b12_magnetic_cutoff", "select * from compounds where ms >= 0.18::double", ["compounds"])
def b12(spark, sf):
    return magnetic_cutoff(fixture(spark, sf, "compounds"), "ms")


@entry(
    "b13_first_anisotropy",
    """select k, ln, (doc->>'$.properties.magnetics."magnetocrystalline anisotropy constants".value[0]')::double as k1
       from good""",
    ["good"],
    digits=["k1"],
)
def b13(spark, sf):
    rows = documents.first_anisotropy(documents.retype(_flat(spark, sf)), out="k1")
    return rows.select("k", "ln", "k1")


@entry(
    "b14_element_contains",
    """select contains(formula, 'Fe') as has_fe, contains(formula, 'S') as has_s_text, count(*) as n from compounds
       group by 1, 2""",
    ["compounds"],
)
def b14(spark, sf):
    return (
        fixture(spark, sf, "compounds")
        .groupBy(
            F.expr(fx.contains_element("formula", "Fe")).alias("has_fe"),
            F.expr(fx.contains_element("formula", "S")).alias("has_s_text"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- formulas and compositions


@entry("c1_composition", "select formula, el, n from compounds_parts", ["compounds_features"])
def c1(spark, sf):
    parsed = fx.with_parts(_formulas(spark, sf))
    return parsed.select("formula", F.explode(F.expr(fx.parts_map("parts"))).alias("el", "n"))


@entry(
    "c2_compound_radix",
    "select formula, compoundradix::bigint as radix from compounds_radix",
    ["compounds_features"],
)
def c2(spark, sf):
    parsed = fx.with_parts(_formulas(spark, sf))
    return parsed.select("formula", F.expr(fx.radix("parts")).cast("bigint").alias("radix"))


def _wide_sql(value: str, missing: str, symbols: list[str], source: str) -> str:
    cells = ", ".join(f"coalesce(max(case when el = '{s}' then {value} end), {missing}) as {s}" for s in symbols)
    return f"select d.formula, {cells} from (select distinct formula from {source}) d left join "


_SYMBOLS = sorted(row[0] for row in dimensions.SAMPLE_ELEMENTS)


@entry(
    "c3_stoichiometry",
    _wide_sql("trunc(n)::bigint", "0", _SYMBOLS, "named") + "parts p on p.formula = d.formula group by d.formula",
    ["exports"],
    ["named as (select composition as formula from exports)", f"parts as ({o._tokens('named')})"],
)
def c3(spark, sf):
    rows = cleaning.rename_formula(fixture(spark, sf, "exports"))
    return composition.stoichiometry_table(
        composition.formula_counts(rows).select("formula"), dimensions.sample_elements(spark)
    )


@entry(
    "c4_symbols_by_length",
    """select distinct s as symbol, length(s)::bigint as len from
       (select unnest(regexp_extract_all(composition, '[A-Z][a-z]*')) as s from exports)""",
    ["exports"],
)
def c4(spark, sf):
    rows = composition.formula_counts(cleaning.rename_formula(fixture(spark, sf, "exports")))
    symbols = rows.select(F.expr(f"explode({fx.symbol_tokens('formula')}) as symbol")).distinct()
    return dimensions.symbols_by_length(symbols).select("symbol", F.col("len").cast("bigint").alias("len"))


@entry(
    "c5_element_occurrence",
    """select symbol as element, count(el) as count, count(distinct formula) as n_formulas from elements left join
       (select formula, unnest(regexp_extract_all(formula, '[A-Z][a-z]*')) as el from compounds) on el = symbol
       group by symbol""",
    ["compounds", "elements"],
)
def c5(spark, sf):
    return composition.element_occurrence(fixture(spark, sf, "compounds"), dimensions.sample_elements(spark))


@entry("c6_atomic_fraction", "select formula, el, af from compounds_frac", ["compounds_features"], digits=["af"])
def c6(spark, sf):
    symbols = dimensions.known_symbols(dimensions.sample_elements(spark))
    parsed = fx.with_parts(_formulas(spark, sf))
    fracs = fx.fractions(fx.stoichiometry("parts", symbols))
    return parsed.selectExpr("formula", f"explode({fracs}) as p").select("formula", "p.el", F.col("p.n").alias("af"))


@entry(
    "c7_fraction_table",
    _wide_sql("af", "null", _SYMBOLS, "compounds") + "compounds_frac p on p.formula = d.formula group by d.formula",
    ["compounds_features"],
    digits=_SYMBOLS,
)
def c7(spark, sf):
    return composition.atomic_fraction_table(_formulas(spark, sf), dimensions.sample_elements(spark))


@entry(
    "c8_number_extraction",
    """select distinct nullif(regexp_extract(t, '\\d*\\.\\d+'), '')::double as en, nullif(regexp_extract(g, '\\d+'), '')::double as grp
       from (select concat('about ', l_discount, ' (Pauling)') as t,
                    case when l_linenumber = 7 then 'Lanthanide' else concat('Group ', l_linenumber, '/', l_orderkey) end as g
             from lineitem)""",
    [],
)
def c8(spark, sf):
    texts = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.concat(F.lit("about "), F.col("l_discount").cast("string"), F.lit(" (Pauling)")).alias("t"),
        F.when(F.col("l_linenumber") == 7, F.lit("Lanthanide"))
        .otherwise(F.concat(F.lit("Group "), F.col("l_linenumber"), F.lit("/"), F.col("l_orderkey")))
        .alias("g"),
    )
    return texts.select(
        dimensions.electronegativity_value(F.col("t")).alias("en"), dimensions.group_number(F.col("g")).alias("grp")
    ).distinct()


# --- weighted features

_SINGLE = {
    "d1_electronegativity": "electronegw",
    "d2_atomic_weight": "Zw",
    "d3_group": "groupw",
    "d4_period": "periodw",
    "d5_melting_point": "meltingTw",
    "d6_valence": "valencew",
    "d7_pair_enthalpy": "miedemaH",
    "d8_mixing_entropy": "stoicentw",
}


def _single(feature: str) -> Query:
    return lambda spark, sf: featurise(_formulas(spark, sf), *_dims(spark)).select("formula", feature)


for _name, _feature in _SINGLE.items():
    entry(
        _name, f"select formula, {_feature} from compounds_distinct", ["compounds_features"], digits=[_feature]
    )(_single(_feature))


@entry("d9_feature_table", *_FEATURE_TABLE, digits=_TABLE_DIGITS)
def d9(spark, sf):
    return _table(spark, sf)


@entry("d10_process_export", "select * from feat_cleaned", ["feat_cleaned"], digits=_TABLE_DIGITS)
def d10(spark, sf):
    return _table(spark, sf, "exports")


# --- splits


@entry("e1_features_target", "select * exclude (formula) from feat", ["feat"], digits=_TABLE_DIGITS)
def e1(spark, sf):
    return splits.features_and_target(_table(spark, sf))


@entry("e2_aligned_test", "select * from feat_cleaned", ["feat_cleaned"], digits=_TABLE_DIGITS)
def e2(spark, sf):
    train, test = _table(spark, sf), _table(spark, sf, "exports")
    shuffled = test.select(*sorted(test.columns), F.lit(1).alias("unused"))
    return splits.align_features(train, shuffled)[1]


@entry("e3_holdout", "select formula, is_train from holdout", ["holdout"])
def e3(spark, sf):
    return splits.holdout_split(_table(spark, sf)).select("formula", "is_train")


@entry(
    "e4_kfold",
    "select formula, (ntile(10) over (order by md5(concat(formula, '#', 0)), formula))::int as fold from feat",
    ["feat"],
)
def e4(spark, sf):
    return splits.kfold(_table(spark, sf), 10).select("formula", "fold")


@entry("e4_kfold_contiguous", "select formula, (ntile(5) over (order by formula))::int as fold from feat", ["feat"])
def e4_contiguous(spark, sf):
    return splits.kfold(_table(spark, sf), 5, seed=None).select("formula", "fold")


@entry(
    "e5_repeated_kfold",
    """select seed, formula, (ntile(10) over (partition by seed order by md5(concat(formula, '#', seed)), formula))::int as fold
       from feat, unnest([0, 5, 10, 15, 20]) as t(seed)""",
    ["feat"],
)
def e5(spark, sf):
    return splits.repeated_kfold(_table(spark, sf), 10, SEEDS).select("seed", "formula", "fold")


# --- models


def _plane(key: str, params: dict | None = None) -> Query:
    def run(spark, sf):
        table = _kept(spark, sf)
        return fit_model(key, table, PLANE, params=params).transform(table).select("formula", F.col("prediction").alias("yhat"))

    return run


_PLANE_BODY = "select formula, b + w1 * valencew + w2 * electronegw as yhat from feat, fit"
entry("f1_linear", _PLANE_BODY, ["feat"], o.plane_fit("feat", "fit"), ["yhat"])(_plane("linear"))
entry("f2_ridge", _PLANE_BODY, ["feat"], o.plane_fit("feat", "fit", 1.0), ["yhat"])(_plane("ridge"))

_LINE = """fit as (select {slope} as w, mx, my from (select avg(valencew) as mx, avg(ms) as my, var_pop(valencew) as cxx,
           covar_pop(valencew, ms) as cxy from feat))"""


def _line(key: str, params: dict) -> Query:
    def run(spark, sf):
        table = _kept(spark, sf)
        model = fit_model(key, table, ["valencew"], params=params)
        return model.transform(table).select("formula", F.col("prediction").alias("yhat"))

    return run


_LINE_BODY = "select formula, my + w * (valencew - mx) as yhat from feat, fit"
entry("f3_lasso", _LINE_BODY, ["feat"], [_LINE.format(slope=o.slope("0.0005", "0"))], ["yhat"])(
    _line("lasso", {"alpha": 0.0005})
)
entry("f4_elasticnet", _LINE_BODY, ["feat"], [_LINE.format(slope=o.slope("0.001 * 0.2", "0.001 * 0.8"))], ["yhat"])(
    _line("elasticnet", {"alpha": 0.001, "l1_ratio": 0.2})
)


def _stationary(key: str, params: dict | None = None) -> Query:
    """Whether the fit on all nine features meets the first-order conditions of its loss, feature by feature.

    With the mean product g of a centred feature and the residuals, the penalties a1 |w| and a2 w^2 / 2 ask for
    g = a2 w + a1 sign(w), or for |g| <= a1 where w = 0. ``n`` counts the rows that the predictions cover.
    """

    def run(spark, sf):
        table = _kept(spark, sf)
        spec = MODELS[key]
        settings = spec.defaults if params is None else params
        model = fit_model(key, table, FEATURES, params=settings)
        scored = model.transform(table)
        residual = F.col("ms") - F.col("prediction")
        rows = scored.agg(
            F.count(F.lit(1)).alias("n"),
            F.stddev_pop("ms").alias("sd"),
            *[F.covar_pop(F.col(f), residual).alias(f"g_{f}") for f in FEATURES],
            *[F.stddev_pop(f).alias(f"sd_{f}") for f in FEATURES],
        )
        alpha, ratio = settings.get("alpha", 0.0), settings.get("l1_ratio", 1.0 if key == "lasso" else 0.0)
        a1 = F.lit(alpha * ratio if key in ("lasso", "elasticnet") else 0.0)
        a2 = F.lit(alpha) / F.col("n") if key == "ridge" else F.lit(alpha * (1 - ratio))
        checks = []
        for f, w in zip(FEATURES, map(float, model.fit.coefficients)):
            slack = F.lit(1e-6) * F.col(f"sd_{f}") * F.col("sd")
            force = F.col(f"g_{f}") - a2 * w
            held = F.abs(force - a1 * float((w > 0) - (w < 0))) <= slack if w else F.abs(force) <= a1 + slack
            checks.append(F.struct(F.lit(f).alias("feature"), "n", held.alias("stationary")))
        return rows.select(F.inline(F.array(*checks)))

    return run


_STATIONARY = f"select unnest({FEATURES!r}) as feature, count(*) as n, true as stationary from feat"
entry("f1_linear_nine", _STATIONARY, ["feat"])(_stationary("linear"))
entry("f2_ridge_nine", _STATIONARY, ["feat"])(_stationary("ridge"))
entry("f3_lasso_nine", _STATIONARY, ["feat"])(_stationary("lasso", {"alpha": 0.0005}))
entry("f4_elasticnet_nine", _STATIONARY, ["feat"])(_stationary("elasticnet", {"alpha": 0.001, "l1_ratio": 0.2}))


def _held_out(key: str, params: dict | None = None) -> Query:
    def run(spark, sf):
        model = _fitted(spark, sf, key, params)
        return predict(model, _holdout(spark, sf)[1], MODELS[key].name, keep=["formula"])

    return run


entry("f5_random_forest")(_held_out("rf"))
entry("f6_boosted_trees")(_held_out("xgb"))


def _table_agrees(key: str) -> Query:
    """Spark's predictions beside those of the model as a table, joined level by level."""

    def run(spark, sf):
        train, test = _holdout(spark, sf)
        model = fit_model(key, train, FEATURES)
        by_table = score_by_joins(node_table(model, spark, key == "rf").persist(), test, FEATURES, ["formula"])
        own = model.transform(test).select("formula", F.col("prediction").alias("own"))
        close = F.abs(F.col("own") - F.col("prediction")) < 1e-9
        return own.join(by_table, "formula").select("formula", close.alias("agrees"))

    return run


_AGREES = "select formula, true as agrees from holdout where not is_train"
entry("f5_random_forest_nine", _AGREES, ["holdout"])(_table_agrees("rf"))
entry("f6_boosted_trees_nine", _AGREES, ["holdout"])(_table_agrees("xgb"))

_SPLITS = "select i::int as tree, true as best_split, true as means, true as sizes from range({}) as t(i)"


@entry("f5_forest_splits", _SPLITS.format(2))
def f5_splits(spark, sf):
    """Trees on all rows, with leaves of two rows or more: every split is the best, every node's value its mean."""
    train, _ = _holdout(spark, sf)
    model = fit_forest(train, FEATURES, "ms", n_estimators=2, min_samples_leaf=2, bootstrap=False)
    return split_checks(node_table(model, spark, True).persist(), train, FEATURES, "ms", "formula", least=2)


@entry("f6_boosted_splits", _SPLITS.format(4))
def f6_splits(spark, sf):
    """A chain without sampling: every tree is fitted to the residuals of those before it."""
    train, _ = _holdout(spark, sf)
    model = fit_boosted(train, FEATURES, "ms", n_estimators=4, max_depth=5, subsample=1.0, colsample_bytree=1.0)
    return split_checks(node_table(model, spark, False).persist(), train, FEATURES, "ms", "formula", boosted=True)


entry("f7_kernel_regression")(_held_out("svr"))
entry("f8_neural_regression")(_held_out("mlp"))


def _better_than_mean(key: str) -> Query:
    """A model on nine features with its untuned settings: held-out rows that it predicts, and whether its error on the
    training rows is below that of their mean. The target of these tables hardly depends on the features, so held-out
    errors say nothing."""

    def run(spark, sf):
        train, test = _holdout(spark, sf)
        model = fit_model(key, train, FEATURES)
        mean = float(train.agg(F.avg("ms")).first()[0])

        def loss(residual):
            """The network minimises squares, kernel regression what exceeds its margin."""
            return residual**2 if key == "mlp" else F.greatest(F.abs(residual) - MODELS[key].defaults["epsilon"], F.lit(0.0))

        both = predict(model, train.unionByName(test), MODELS[key].name, keep=["is_train"])
        return both.groupBy("model").agg(
            F.count_if(~F.col("is_train") & F.col("yhat").isNotNull()).alias("n"),
            (
                F.avg(F.when(F.col("is_train"), loss(F.col("y") - F.col("yhat"))))
                < F.avg(F.when(F.col("is_train"), loss(F.col("y") - mean)))
            ).alias("beats_mean"),
        )

    return run


for _key in ("svr", "mlp"):
    entry(
        f"f{7 + (_key == 'mlp')}_{_key}_beats_mean",
        f"select '{MODELS[_key].name}' as model, count(*) as n, true as beats_mean from holdout where not is_train",
        ["holdout"],
    )(_better_than_mean(_key))


@entry(
    "f9_prediction",
    """select formula, model, y, yhat from (
         select formula, 'Linear Regression' as model, ms as y, f.b + f.w1 * valencew + f.w2 * electronegw as yhat
         from holdout, fit f where not is_train union all
         select formula, 'Ridge', ms, r.b + r.w1 * valencew + r.w2 * electronegw from holdout, ridge r where not is_train)""",
    ["holdout"],
    ["train as (select * from holdout where is_train)"] + o.plane_fit("train", "fit") + o.plane_fit("train", "ridge", 1.0),
    ["y", "yhat"],
)
def f9(spark, sf):
    train, test = _holdout(spark, sf)
    return splits.union_all(
        [predict(fit_model(m, train, PLANE), test, MODELS[m].name, keep=["formula"]) for m in ("linear", "ridge")]
    )


_FOLDS = [
    "cut as (select valencew as x, ms as y, ntile(5) over (order by formula) as fold from feat)",
    """fold_sums as (select k, avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy, count(*) as n
       from cut, range(1, 6) t(k) where fold <> k group by k)""",
]


def _search(key: str) -> Query:
    return lambda spark, sf: tuning.grid_search(key, _kept(spark, sf), ["valencew"])[1]


def _search_sql(points: str, names: str, weight: str) -> tuple[str, list[str], list[str]]:
    extra = [
        *_FOLDS,
        f"grid as ({points})",
        f"""errors as (select point, k, avg((y - my - ({weight}) * (x - mx)) ** 2) as mse from cut, fold_sums, grid
            where fold = k group by point, k)""",
    ]
    return f"select point, {names}, avg(mse) as mse from errors join grid using (point) group by point, {names}", ["feat"], extra


def _grid_sql(key: str) -> str:
    settings = MODELS[key].settings()
    names = ", ".join(settings[0])
    rows = [(i, *[str(v) for v in s.values()]) for i, s in enumerate(settings)]
    return f"select * from ({o._values(rows)}) g(point, {names})"


entry(
    "f10_tune_ridge", *_search_sql(_grid_sql("ridge"), "alpha", "cxy / (cxx + alpha::double / n)"), digits=["mse"]
)(_search("ridge"))
entry(
    "f11_tune_lasso", *_search_sql(_grid_sql("lasso"), "alpha", o.slope("alpha::double", "0")), digits=["mse"]
)(_search("lasso"))
entry(
    "f12_tune_elasticnet",
    *_search_sql(
        _grid_sql("elasticnet"),
        "alpha, l1_ratio",
        o.slope("alpha::double * l1_ratio::double", "alpha::double * (1 - l1_ratio::double)"),
    ),
    digits=["mse"],
)(_search("elasticnet"))


def _search_agrees(key: str) -> Query:
    """The search on all nine features: whether every score is the mean of the folds' errors, taken from held-out rows."""

    def run(spark, sf):
        table = _kept(spark, sf)
        scores = tuning.grid_search(key, table, FEATURES)[1].select("point", "mse")
        direct = tuning.linear_search_predictions(key, table, FEATURES)
        error = (F.col("y") - F.col("yhat")) ** 2
        by_fold = direct.groupBy("model", "fold").agg(F.avg(error).alias("mse"))
        means = by_fold.groupBy(F.col("model").cast("bigint").alias("point")).agg(F.avg("mse").alias("direct"))
        agrees = F.abs(F.col("mse") - F.col("direct")) < 1e-9 * F.greatest(F.col("direct"), F.lit(1.0))
        return scores.join(means, "point").select("point", agrees.alias("agrees"))

    return run


for _name, _key in (("f10_tune_ridge_nine", "ridge"), ("f11_tune_lasso_nine", "lasso"), ("f12_tune_elasticnet_nine", "elasticnet")):
    entry(_name, f"select i::bigint as point, true as agrees from range({len(MODELS[_key].settings())}) as t(i)")(
        _search_agrees(_key)
    )


def _search_grid(key: str, grid: dict[str, list] | None = None) -> Query:
    return lambda spark, sf: tuning.grid_search(key, _kept(spark, sf), FEATURES, grid=grid)[1]


def _search_refits(key: str, grid: dict[str, list], k: int = 2) -> Query:
    """A search beside a fit of its own for every point and fold: whether each score is the mean of their errors."""

    def run(spark, sf):
        table = _kept(spark, sf)
        scores = tuning.grid_search(key, table, FEATURES, k=k, grid=grid)[1].select("point", "mse")
        folds = sized(splits.kfold(table.select("formula", *FEATURES, "ms"), k, "formula", seed=None)).persist()
        rows = []
        for point, setting in enumerate(MODELS[key].settings(grid)):
            errors = []
            for fold in range(1, k + 1):
                model = fit_model(key, folds.where(F.col("fold") != fold), FEATURES, params=setting)
                errors.append(tuning._mse(model, folds.where(F.col("fold") == fold), "ms"))
            rows.append((point, sum(errors) / k))
        alone = spark.createDataFrame(rows, "point long, alone double")
        close = F.abs(F.col("mse") - F.col("alone")) < 1e-6 * F.col("alone")
        return scores.join(alone, "point").select("point", close.alias("agrees"))

    return run


_REFITS = {
    "f13_forest_cuts": ("rf", {"n_estimators": [8], "max_depth": [None, 4], "min_samples_split": [10], "min_samples_leaf": [2]}),
    "f15_kernel_passes": ("svr", {"C": [1.0], "epsilon": [0.1], "kernel": ["rbf", "poly"]}),
    "f16_network_passes": ("mlp", {"hidden_layer_sizes": [(20,)], "activation": ["relu", "tanh"], "max_iter": [30], "early_stopping": [True]}),
}
for _name, (_key, _grid) in _REFITS.items():
    _points = len(MODELS[_key].settings(_grid))
    entry(_name, f"select i::bigint as point, true as agrees from range({_points}) as t(i)")(_search_refits(_key, _grid))

entry("f13_tune_forest")(_search_grid("rf"))
# The full grid has 729 points; see the README for what it would take.
entry("f14_tune_boosted_reduced")(
    _search_grid("xgb", {"n_estimators": [5, 10], "learning_rate": [0.1, 0.2], "max_depth": [3]})
)
entry("f15_tune_kernel")(_search_grid("svr"))
entry("f16_tune_neural")(_search_grid("mlp"))


# --- evaluation


@entry(
    "g1_holdout_metrics",
    """select model, avg((y - yhat) ** 2) as mse, avg(abs(y - yhat)) as mae,
       1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) as r2 from predictions group by model""",
    ["predictions"],
    digits=["mse", "mae", "r2"],
)
def g1(spark, sf):
    return metrics.holdout_metrics(fixture(spark, sf, "predictions"))


@entry(
    "g2_mean_relative_error",
    "select model, sum(abs(y - yhat) / (abs(y) + 1e-8)) / count(*) as mre from predictions group by model",
    ["predictions"],
    digits=["mre"],
)
def g2(spark, sf):
    rows = fixture(spark, sf, "predictions")
    return rows.groupBy("model").agg(metrics.mean_relative_error(F.col("y"), F.col("yhat")).alias("mre"))


@entry("g3_fold_metrics", "select * from folds_metrics", ["folds_metrics"], digits=metrics.METRICS)
def g3(spark, sf):
    return metrics.fold_metrics(fixture(spark, sf, "predictions"))


@entry(
    "g3_linear_cv",
    """select seed, 'Linear Regression' as model, fold, avg((y - yhat) ** 2) as mse, avg(abs(y - yhat)) as mae,
       avg(abs(y - yhat) / (abs(y) + 1e-8)) as mre, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) as r2
       from (select c.seed, c.fold, y, my + w * (x - mx) as yhat from cut c join fits f on f.seed = c.seed and f.k = c.fold)
       group by seed, fold""",
    ["feat"],
    [
        """cut as (select seed, valencew as x, ms as y, ntile(10) over (partition by seed order by md5(concat(formula, '#', seed)),
           formula)::int as fold from feat, unnest([0, 5, 10, 15, 20]) as t(seed))""",
        """fits as (select seed, k, avg(x) as mx, avg(y) as my, covar_pop(x, y) / var_pop(x) as w from cut, range(1, 11) t(k)
           where fold <> k group by seed, k)""",
    ],
    metrics.METRICS,
)
def g3_linear(spark, sf):
    return tuning.cross_validate(_kept(spark, sf), ["valencew"], ["linear"], 10, SEEDS)


_TUNED = [
    """cut as (select seed, formula, valencew as x, ms as y, ntile(10) over (partition by seed
       order by md5(concat(formula, '#', seed)), formula)::int as fold from feat, unnest([0, 5]) as t(seed))""",
    """training as (select seed, k, formula, x, y, ntile(5) over (partition by seed, k order by formula) as inner_fold
       from cut, range(1, 11) t(k) where fold <> k)""",
    """inner_sums as (select seed, k, i, avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy, count(*) as n
       from training, range(1, 6) t(i) where inner_fold <> i group by seed, k, i)""",
    "alphas as (select * from (values (0, 0.01::double), (1, 0.1::double), (2, 1.0::double), (3, 10.0::double), (4, 50.0::double)) a(point, alpha))",
    """inner_errors as (select seed, k, i, point, alpha, avg((y - my - cxy / (cxx + alpha / n) * (x - mx)) ** 2) as mse
       from training join inner_sums using (seed, k), alphas where inner_fold = i group by seed, k, i, point, alpha)""",
    """chosen as (select seed, k, arg_min(alpha, mse) as alpha from
       (select seed, k, alpha, avg(mse) as mse from inner_errors group by seed, k, alpha) group by seed, k)""",
    """fits as (select seed, k, mx, my, cxy / (cxx + alpha / n) as w from chosen join
       (select seed, k, avg(x) as mx, avg(y) as my, var_pop(x) as cxx, covar_pop(x, y) as cxy, count(*) as n
        from training group by seed, k) using (seed, k))""",
]


@entry(
    "g3_tuned_linear_cv",
    """select seed, 'Ridge' as model, fold, avg((y - yhat) ** 2) as mse, avg(abs(y - yhat)) as mae,
       avg(abs(y - yhat) / (abs(y) + 1e-8)) as mre, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) as r2
       from (select c.seed, c.fold, y, my + w * (x - mx) as yhat from cut c join fits f on f.seed = c.seed and f.k = c.fold)
       group by seed, fold""",
    ["feat"],
    _TUNED,
    metrics.METRICS,
)
def g3_tuned(spark, sf):
    return tuning.cross_validate(_kept(spark, sf), ["valencew"], ["ridge"], 10, [0, 5], tune=True)


@entry("g3_cross_validation")
def g3_models(spark, sf):
    return tuning.cross_validate(_kept(spark, sf), FEATURES, list(MODELS), 10, [0])


_SUMMARY = [f"{m}_{s}" for m in metrics.METRICS for s in ("mean", "std")]


@entry(
    "g4_cv_summary",
    "select model, "
    + ", ".join(f"avg({m}) as {m}_mean, stddev_samp({m}) as {m}_std" for m in metrics.METRICS)
    + " from folds_metrics group by model",
    ["folds_metrics"],
    digits=_SUMMARY,
)
def g4(spark, sf):
    return metrics.cv_summary(metrics.fold_metrics(fixture(spark, sf, "predictions")))


@entry(
    "g5_win_counts",
    """select 'a' as model_a, 'b' as model_b, count(*) filter (a.mse < b.mse) as wins_a, count(*) filter (b.mse < a.mse) as wins_b,
       count(*) filter (a.mse = b.mse) as ties from folds_metrics a join folds_metrics b using (fold)
       where a.model = 'a' and b.model = 'b'""",
    ["folds_metrics"],
)
def g5(spark, sf):
    return metrics.win_counts(metrics.fold_metrics(fixture(spark, sf, "predictions")), "a", "b")


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    return significance.paired_differences(metrics.fold_metrics(fixture(spark, sf, "predictions")), "a", "b")


# For nine degrees of freedom the t distribution is a finite sum in the angle atan(t / 3).
@entry(
    "g6_paired_t",
    """select metric, n, t, 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * cos(th) ** 3 + 8.0 / 15 * cos(th) ** 5
         + 48.0 / 105 * cos(th) ** 7)) as p
       from (select metric, n, t, atan(abs(t) / 3) as th from
             (select metric, count(d) as n, avg(d) / (stddev_samp(d) / sqrt(count(d))) as t from diffs group by metric))""",
    ["diffs"],
    digits=["t", "p"],
)
def g6(spark, sf):
    return significance.paired_t(_diffs(spark, sf))


# Without ties the exact p-value counts the sign patterns whose rank sum is at most W.
@entry(
    "g7_wilcoxon",
    """select metric, n, w, least(1, 2 * (select count(*) from patterns where total <= w) / 1024.0::double) as p
       from (select metric, count(*) as n, least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end))::double as w
             from (select metric, d, rank() over (partition by metric order by abs(d)) as r from diffs where d <> 0) group by metric)""",
    ["diffs"],
    ["""patterns as (select m, sum(case when (m >> (i - 1)) & 1 = 1 then i else 0 end) as total
        from range(1024) t(m), range(1, 11) s(i) group by m)"""],
    digits=["w", "p"],
)
def g7(spark, sf):
    return significance.wilcoxon(_diffs(spark, sf))


_SCORED = ["train as (select * from holdout where is_train)", "test as (select * from holdout where not is_train)"] + o.plane_fit(
    "train", "fit"
)


@entry(
    "g8_permutation_importance",
    """select feature, avg(importance) as importance_mean, stddev_pop(importance) as importance_std from
       (select feature, repeat, (sum((ms - yhat) ** 2) - sum((ms - base) ** 2)) / (var_pop(ms) * count(*)) as importance from
         (select feature, repeat, ms, b + w1 * valencew + w2 * electronegw as base,
                 b + w1 * case when feature = 'valencew' then dv else valencew end
                   + w2 * case when feature = 'electronegw' then de else electronegw end as yhat
          from replicas join donors using (rk), fit) group by feature, repeat) group by feature""",
    ["holdout"],
    _SCORED
    + [
        """donors as (select valencew as dv, electronegw as de, row_number() over (order by md5(concat(formula, '#', '0/donor')),
           formula) as rk from test)""",
        """replicas as (select *, row_number() over (partition by feature, repeat
             order by md5(concat(formula, '#', '0/', repeat)), formula) as rk
           from test, unnest(['valencew', 'electronegw']) as f(feature), range(10) as r(repeat))""",
    ],
    ["importance_mean", "importance_std"],
)
def g8(spark, sf):
    train, test = _holdout(spark, sf)
    return attribution.permutation_importance(fit_model("linear", train, PLANE), test, PLANE)


@entry("g8_forest_importance")
def g8_forest(spark, sf):
    return attribution.permutation_importance(
        _fitted(spark, sf, "rf"), _holdout(spark, sf)[1], FEATURES
    )


@entry(
    "g8_forest_agrees",
    f"select feature, true as agrees from unnest([{', '.join(repr(f) for f in FEATURES)}]) as t(feature)",
)
def g8_forest_agrees(spark, sf):
    """Importances from Spark's predictions beside those from the trees' own nodes."""
    model, test = _fitted(spark, sf, "rf"), _holdout(spark, sf)[1]
    own = attribution.permutation_importance(model, test, FEATURES, repeats=2).select("feature", "importance_mean")
    other = attribution.permutation_importance(cut_trees(model, spark, True), test, FEATURES, repeats=2)
    close = F.abs(F.col("importance_mean") - F.col("by_nodes")) < 1e-9
    return own.join(other.select("feature", F.col("importance_mean").alias("by_nodes")), "feature").select("feature", close.alias("agrees"))


@entry(
    "g9_shapley",
    """select formula, b + w1 * mv + w2 * me as base_value, b + w1 * valencew + w2 * electronegw as prediction,
       w1 * (valencew - mv) as phi_valencew, w2 * (electronegw - me) as phi_electronegw from test, fit,
       (select avg(valencew) as mv, avg(electronegw) as me from
         (select * from train order by md5(concat(formula, '#', 0)), formula limit 100))""",
    ["holdout"],
    _SCORED,
    ["base_value", "prediction", "phi_valencew", "phi_electronegw"],
)
def g9(spark, sf):
    train, test = _holdout(spark, sf)
    model = fit_model("linear", train, PLANE)
    return attribution.shapley_values(model, test, attribution.background_rows(train, PLANE), PLANE)


@entry(
    "g9_linear_shapley",
    "select formula, true as adds_up, true as base_is_mean from holdout where not is_train",
    ["holdout"],
)
def g9_linear(spark, sf):
    """Nine features, all training rows as background: attributions add up, the base is the mean training prediction."""
    train, test = _holdout(spark, sf)
    model = fit_model("linear", train, FEATURES)
    mean = float(model.transform(train).agg(F.avg("prediction")).first()[0])
    values = attribution.linear_shapley_values(model, test, train, FEATURES)
    total = sum((F.col(f"phi_{f}") for f in FEATURES), F.col("base_value"))
    return values.select(
        "formula",
        (F.abs(total - F.col("prediction")) < 1e-9).alias("adds_up"),
        (F.abs(F.col("base_value") - mean) < 1e-9).alias("base_is_mean"),
    )


@entry("g9_forest_shapley")
def g9_forest(spark, sf):
    train, test = _holdout(spark, sf)
    background = attribution.background_rows(train, FEATURES)
    values = attribution.shapley_values(_fitted(spark, sf, "rf"), test, background, FEATURES)
    return attribution.shapley_summary(values, FEATURES)


@entry(
    "g9_forest_adds_up",
    "select formula, true as adds_up, true as base_is_mean from holdout where not is_train",
    ["holdout"],
)
def g9_forest_adds_up(spark, sf):
    """Attributions of a forest add up to its prediction; the base is its mean over the background."""
    train, test = _holdout(spark, sf)
    background = attribution.background_rows(train, FEATURES, size=20)
    model = fit_model("rf", train, FEATURES)
    values = attribution.shapley_values(model, test, background, FEATURES)
    mean = float(cut_trees(model, spark, True).predict(np.array(background, float)).mean())
    total = sum((F.col(f"phi_{f}") for f in FEATURES), F.col("base_value"))
    return values.select(
        "formula",
        (F.abs(total - F.col("prediction")) < 1e-9).alias("adds_up"),
        (F.abs(F.col("base_value") - mean) < 1e-9).alias("base_is_mean"),
    )


_CASE_FITS = o.plane_fit("feat", "fit") + o.plane_fit("feat", "ridge", 1.0) + o.series_features()
_CASE_ROWS = """select system, formula, x, 'linear' as source, fit.b + fit.w1 * valencew + fit.w2 * electronegw as value
    from series_x, fit union all
    select system, formula, x, 'ridge', ridge.b + ridge.w1 * valencew + ridge.w2 * electronegw from series_x, ridge"""


def _plane_models(spark: SparkSession, sf: str) -> dict[str, Any]:
    table = _kept(spark, sf)
    return {m: fit_model(m, table, PLANE) for m in ("linear", "ridge")}


for _name, _system in {"g10_feal_case": "FeAl", "g11_feco_case": "FeCo", "g12_fecr_case": "FeCr"}.items():

    def _case(spark, sf, system=_system):
        return cases.case_studies([system], _plane_models(spark, sf), *_dims(spark))

    entry(_name, f"select * from ({_CASE_ROWS}) where system = '{_system}'", ["feat"], _CASE_FITS, ["x", "value"])(_case)


@entry(
    "g13_case_comparison",
    f"select system, x, source, value from ({_CASE_ROWS}) union all select system, x, 'literature', value from literature",
    ["feat"],
    _CASE_FITS + [o.literature_table()],
    ["x", "value"],
)
def g13(spark, sf):
    return cases.comparison_table(_plane_models(spark, sf), *_dims(spark))


@entry("g13_tree_comparison")
def g13_trees(spark, sf):
    models = {
        "random forest": _fitted(spark, sf, "rf"),
        "boosted trees": _fitted(spark, sf, "xgb"),
        "ridge regression": _fitted(spark, sf, "ridge"),
    }
    return cases.comparison_table(models, *_dims(spark))


@entry(
    "g13_tree_agrees",
    "select system, x, source, true as agrees from series_x, (values ('random forest'), ('boosted trees')) s(source)",
    ["feat"],
    _CASE_FITS,
    ["x"],
)
def g13_tree_agrees(spark, sf):
    """The trees' predictions of the alloy series, from Spark beside those from the trees' own nodes."""
    models = {"random forest": _fitted(spark, sf, "rf"), "boosted trees": _fitted(spark, sf, "xgb")}
    nodes = {name: cut_trees(m, spark, name == "random forest") for name, m in models.items()}
    own, other = (
        # A point without a fraction has its place in the series too.
        cases.comparison_table(m, *_dims(spark))
        .filter("source <> 'literature'")
        .withColumn("at", F.coalesce(F.round("x", 6), F.lit(-1.0)))
        for m in (models, nodes)
    )
    other = other.select("system", "at", "source", F.col("value").alias("by_nodes"))
    close = F.abs(F.col("value") - F.col("by_nodes")) < 1e-9
    return own.join(other, ["system", "at", "source"]).select("system", "x", "source", close.alias("agrees"))


# --- distributions


@entry(
    "h1_group_histogram",
    """select g as grp, i as bin, i * 0.2::double as lo, (i + 1) * 0.2::double as hi, count(value) as n
       from unnest(['Fe', 'Co', 'Cr', 'Mn']) as t(g) cross join range(12) as r(i) left join grouped
         on grp = g and value >= i * 0.2::double and (value < (i + 1) * 0.2::double or (i = 11 and value = 12 * 0.2::double))
       group by g, i""",
    ["grouped"],
    digits=["lo", "hi"],
)
def h1(spark, sf):
    return distributions.group_histogram(fixture(spark, sf, "compounds"))


@entry(
    "h2_auto_histogram",
    """select i as bin, lo + i * step as lo, case when i = k - 1 then hi else lo + (i + 1) * step end as hi, count(ms) as n
       from bins cross join range(10000) as r(i) left join compounds on ms >= lo + i * step and (ms < lo + (i + 1) * step
         or (i = k - 1 and ms <= hi)) where i < k group by i, k, lo, hi, step""",
    ["compounds"],
    [
        """stats as (select min(ms) as lo, max(ms) as hi, count(ms) as n,
           quantile_cont(ms, 0.75) - quantile_cont(ms, 0.25) as iqr from compounds)""",
        """bins as (select lo, hi, ceil((hi - lo) / width)::bigint as k, (hi - lo) / ceil((hi - lo) / width) as step from
           (select lo, hi, least(2 * iqr / n ** (1.0 / 3), (hi - lo) / (log2(n) + 1)) as width from stats))""",
    ],
    ["lo", "hi"],
)
def h2(spark, sf):
    return distributions.auto_histogram(fixture(spark, sf, "compounds"))


def _density_sql(grid: int, cut: float) -> tuple[str, list[str], list[str]]:
    extra = [
        f"""bands as (select grp, count(*) as size, bw, min(value) - {cut} * bw as lo, max(value) + {cut} * bw as hi from grouped
            join (select grp, stddev_samp(value) * count(*) ** (-0.2) as bw from grouped group by grp) using (grp)
            group by grp, bw)""",
        f"grid as (select *, lo + i * ((hi - lo) / {grid - 1}) as x from bands, range({grid}) as r(i))",
        "vals as (select grp, value, count(*) as c from grouped group by all)",
    ]
    body = """select grp, i, x, sum(c * exp(-0.5 * ((x - value) / bw) ** 2)) / (size * bw * sqrt(2 * pi())) as density
              from grid join vals using (grp) group by grp, i, x, size, bw"""
    return body, ["grouped"], extra


@entry("h3_density", *_density_sql(200, 0.0), digits=["x", "density"])
def h3(spark, sf):
    return distributions.density(fixture(spark, sf, "compounds"))


@entry(
    "h4_violin_quartiles",
    """select grp, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3,
       count(*) as n from grouped group by grp""",
    ["grouped"],
    digits=["q1", "q2", "q3"],
)
def h4(spark, sf):
    return distributions.violin_quartiles(fixture(spark, sf, "compounds"))


@entry("h4_violin_density", *_density_sql(100, 2.0), digits=["x", "density"])
def h4_density(spark, sf):
    return distributions.violin_density(fixture(spark, sf, "compounds"))


@entry(
    "h5_radix_summary",
    """select radix, case radix when 2 then 'binary' when 3 then 'ternary' else concat(radix, '-component') end as name,
       count(*) as n_compounds from (select compoundradix::int as radix from compounds join compounds_radix using (formula))
       group by radix""",
    ["compounds_features"],
)
def h5(spark, sf):
    return composition.radix_summary(fixture(spark, sf, "compounds"))
