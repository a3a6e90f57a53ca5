import json
import os

import pytest
from pyspark.sql import functions as F

from lodespark.operators.features import FEATURES
from lodespark.plans import jobs
from lodespark.session import scratch_root
from lodespark.sources import dimensions, documents, tabular

# A folder of property documents to check the published counts against; the test is skipped without it.
CORPUS = os.environ.get("LODESPARK_DOCUMENTS")


def _doc(formula, ms, **magnetics):
    wrap = lambda d: {k: {"value": v} for k, v in d.items()}
    return {
        "name": formula,
        "properties": {
            "chemistry": wrap({"chemical formula": formula}),
            "crystal": wrap({"compound space group": 123, "lattice parameters": [1.5, 2.5, 3.5]}),
            "magnetics": wrap({"saturation magnetization": ms, **magnetics}),
        },
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "deep #1").mkdir()
    docs = [_doc("Fe3B", 1.0), _doc("Fe3B", 2.0), _doc("FeCo", 0.1), _doc("none", 1.0), _doc("FeNi", "None")]
    docs += [_doc(f"Fe{i}Al{j}", 0.2 + i / 10 + j / 20) for i in range(1, 9) for j in range(1, 6)]
    docs.append(_doc("CoNi", 1.2, **{"magnetocrystalline anisotropy constants": [0.5, 0], "curie temperature": "n/a"}))
    docs.append(_doc("MnNi", 1.1, **{"magnetocrystalline anisotropy constants": []}))
    for i, d in enumerate(docs):
        (root / ("deep #1" if i % 2 else ".") / f"d#{i}.json").write_text(json.dumps(d, ensure_ascii=False), "latin-1")
    (root / "bad.json").write_text('{"properties": {"magnetics": {"saturation magnetization": {"value": .692}}}}')
    (root / "notes.txt").write_text("not a document")
    return str(root)


def test_scan_and_quarantine(spark, folder):
    docs = documents.read_documents(spark, folder)
    assert docs.count() == 48
    bad = documents.quarantined_documents(docs).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["bad.json"]
    assert documents.good_documents(docs).count() == 47
    assert {r.status: r["count"] for r in documents.document_status(docs).groupBy("status").count().collect()} == {
        "good": 47,
        "malformed": 1,
    }


def test_typed_rows(spark, folder):
    rows = documents.load_property_rows(spark, folder)
    assert len(rows.columns) == 32
    assert rows.where("`chemical formula` is null").count() == 1
    assert rows.where("`saturation magnetization` is null").count() == 1
    k1 = documents.first_anisotropy(rows, out="k1").where("k1 is not null").collect()
    assert [(r["chemical formula"], r.k1, r["curie temperature"]) for r in k1] == [("CoNi", 0.5, None)]
    assert rows.first()["lattice parameters"] == [1.5, 2.5, 3.5]


def test_unwrap_and_merge(spark):
    df = spark.createDataFrame([('{"value":5}',), ('{"value":5,"unit":"K"}',), ('{"other":1}',), ("7",)], "j string")
    assert [r.v for r in df.select(documents.unwrap(F.col("j")).alias("v")).collect()] == [
        "5",
        '{"value":5,"unit":"K"}',
        '{"other":1}',
        "7",
    ]
    maps = spark.sql("select map('a', '1', 'b', '2') x, map('b', cast(null as string)) y, map('c', '3') z")
    merged = maps.select(documents.merge_sections(F.col("x"), F.col("y"), F.col("z")).alias("m")).first().m
    assert merged == {"a": "1", "b": None, "c": "3"}


def test_plain_wrappers_are_told_without_a_parser(spark):
    plain = ["Fe7B1", '{"value":""}', '{"value":"Fe2 \u00e9"}', '{"value":17}', '{"value":-3}', '{"value":0}', '{"value":true}']
    odd = [
        None, "", "{", '{"value":', '{"value":}', '{"value":null}', '{"value":"null"}', '{"value":-0}', '{"value":01}', '{"value":1.50}',
        '{"value":1e5}', '{"value":12345678901234567890123}', '{"value":[1.0,2]}', '{"value":[1,}', '{"value":{"value":1}}', '{"value":"a}',
        '{"value":"a\\"b"}', '{"value":"a\\u0041"}', '{"value":"a\tb"}', '{"value":1}\n', '{"value":1} x', '{"value":1,"unit":"K"}',
        '{"value":1,"value":2}', ' {"value":1}', '{ "value":1}', '{"unit":"K"}', '{"value":"a","b":"c"}', '{"value":NaN}', "{'value':1}",
    ]
    node = F.col("j")
    parsed = F.when(F.json_object_keys(node) == F.array(F.lit("value")), F.get_json_object(node, "$.value")).otherwise(node)
    df = spark.createDataFrame([(t,) for t in plain + odd], "j string")
    rows = df.select("j", documents.unwrap(node).alias("v"), parsed.alias("p"), node.rlike(documents.PLAIN_WRAPPER).alias("q")).collect()
    assert [r.v for r in rows] == [r.p for r in rows]
    assert [r.j for r in rows if r.q] == plain[1:] + ['{"value":"null"}']


def test_plain_arrays_are_told_without_a_parser(spark):
    plain = ["[1]", "[18.0,0.02]", "[-1,0,2.50]", "[-0.0,1]", "[123456789012345678,0.00000000000000001]"]
    odd = [
        None, "", "3", "[]", "[1,]", "[,1]", "[1..2]", "[01]", "[-0]", "[1e5]", "[.5]", "[5.]", "[1, 2]", "[1] x", "[1]\n", '["a",1]',
        "[null,1]", "[[1],2]", "[12345678901234567890123]", "[" + ",".join(["1.5"] * 3000) + "]", "[1", "1]", "[NaN]", "{}", "[true]",
    ]
    name, col = "lattice parameters", F.col("`lattice parameters`")
    df = spark.createDataFrame([(t,) for t in plain + odd], "`lattice parameters` string")
    parsed = F.transform(F.from_json(col, "array<string>"), lambda v: v.try_cast("double"))
    want = [repr(r.v) for r in df.select(parsed.alias("v")).collect()]
    assert [repr(r[name]) for r in documents.retype(df).collect()] == want
    told = [r[0] for r in df.where(col.rlike(documents.PLAIN_NUMBERS)).collect()]
    assert told == plain


@pytest.mark.skipif(not CORPUS, reason="LODESPARK_DOCUMENTS names no folder")
def test_corpus_counts(spark, dims):
    docs = documents.read_documents(spark, CORPUS)
    assert (docs.count(), documents.quarantined_documents(docs).count()) == (213, 2)
    rows = documents.load_property_rows(spark, CORPUS).persist()
    target = F.col(jobs.TARGET)
    kept = rows.where(target >= 0.18)
    assert (rows.count(), rows.where(target.isNotNull()).count(), kept.count()) == (211, 209, 195)
    assert rows.select(jobs.FORMULA).distinct().count() == 93 and kept.select(jobs.FORMULA).distinct().count() == 83
    assert rows.where(F.col("magnetocrystalline anisotropy constants").isNotNull()).count() == 24
    table = jobs.property_features(spark, CORPUS, *dims).persist()
    medians = {r[jobs.FORMULA]: r[jobs.TARGET] for r in table.collect()}
    assert medians["Fe4C1"] == pytest.approx(1.858) and medians["Fe6N1"] == pytest.approx(2.094)
    assert medians["Fe3B1"] == pytest.approx(1.641)
    # Every kept formula but the ones whose pair of elements the placeholder table lacks.
    lost = {r[0] for r in kept.select(jobs.FORMULA).distinct().collect()} - set(medians)
    assert all("Sm" in f and "Zr" in f for f in lost) and len(medians) + len(lost) == 83


def test_tabular_round_trip(spark, tmp_path):
    path = str(tmp_path / "export.csv")
    with open(path, "w") as f:
        f.write("id,is_magnetic,composition,total_magnetization_normalized_vol\n")
        f.write("1,True,Fe2O3,0.1\n2,False,Fe2O3,0.2\n3,True,SmFe,0.3\n4,True,CoO,n/a\n5,True,Fe2O3,0.2\n")
    raw = tabular.read_table(spark, path, tabular.EXPORT_SCHEMA)
    assert raw.columns == tabular.EXPORT_SCHEMA.names and raw.count() == 5
    elements, pairs = dimensions.sample_elements(spark), dimensions.sample_pairs(spark)
    sink = str(tmp_path / "features")
    table = jobs.export_features(spark, path, elements, pairs, sink).collect()
    assert [(r[jobs.FORMULA], round(r[jobs.TARGET], 6)) for r in table] == [("Fe2O3", round(0.15 * 11.654052107756696, 6))]
    back = tabular.read_table(spark, sink, tabular.feature_schema(jobs.FORMULA, jobs.TARGET))
    assert back.collect() == table


def test_dimension_files(spark, tmp_path, dims):
    elements_path, pairs_path = str(tmp_path / "e"), str(tmp_path / "p")
    tabular.write_table(dims[0].where("symbol in ('Fe', 'Co')"), elements_path)
    wide = spark.createDataFrame([("Co", 0.0, None), ("Fe", -1.5, 0.0)], "element string, Co double, Fe double")
    tabular.write_table(wide, pairs_path)
    elements, pairs = jobs.load_dimensions(spark, elements_path, pairs_path)
    assert elements.count() == 2
    assert {(r.a, r.b): r.h for r in pairs.collect() if r.a != r.b} == {("Co", "Fe"): -1.5, ("Fe", "Co"): -1.5}


def test_runs_end_to_end(spark, folder, tmp_path, dims):
    table = jobs.property_features(spark, folder, *dims, raw_sink=str(tmp_path / "raw"), sink=str(tmp_path / "t")).persist()
    assert table.columns == [jobs.FORMULA, jobs.TARGET, *FEATURES]
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 47
    run = jobs.holdout_run(table, ["linear", "ridge"], tune=True)
    assert {r.model for r in run.metrics.collect()} == {"Linear Regression", "Ridge"} and run.params["linear"] is None
    assert run.params["ridge"]["alpha"] in (0.01, 0.1, 1.0, 10.0, 50.0)
    foreign = jobs.ood_run(run.train.drop("is_train"), run.test.drop("is_train"), ["lasso"])
    assert foreign.metrics.count() == 1
    cv = jobs.cross_validation_run(table, ["linear", "lasso"], 4, [0, 5])
    assert cv["summary"].count() == 4 and "wins" not in cv
    small = {"rf": {"n_estimators": 3, "max_depth": 3}, "xgb": {"n_estimators": 2, "max_depth": 2}}
    trees = jobs.cross_validation_run(table, ["rf", "xgb"], 3, [0, 5], settings=small)
    assert [w.wins_a + w.wins_b + w.ties for w in trees["wins"].collect()] == [3, 3]
    assert trees["paired_t"].count() == trees["wilcoxon"].count() == 4
    report = jobs.distribution_report(table)
    assert {r.name for r in report["radix"].collect()} == {"binary"} and report["density"].count() > 0
    with pytest.raises(ValueError):
        jobs.holdout_run(table, ["nope"])


def test_interpretation(spark, folder, dims):
    table = jobs.property_features(spark, folder, *dims).persist()
    run = jobs.holdout_run(table, ["ridge"])
    from lodespark.operators.regressors import fit_model

    run.models["rf"] = fit_model("rf", run.train, run.features, jobs.TARGET, {"n_estimators": 3, "max_depth": 3})
    run.models["xgb"] = fit_model("xgb", run.train, run.features, jobs.TARGET, {"n_estimators": 2, "max_depth": 2})
    report = jobs.interpretation_report(run, *dims)
    assert report["importance"].count() == 9 and report["case_studies"].count() == 3 * 39 + 38
    row = report["shapley"].first()
    assert sum(row[f"phi_{f}"] for f in FEATURES) == pytest.approx(row.prediction - row.base_value, abs=1e-9)


def test_scratch_needs_a_shared_folder(spark):
    assert scratch_root(spark)


def test_export_filter_reaches_the_scan(spark, tmp_path):
    from lodespark.operators.cleaning import clean_export

    path = str(tmp_path / "wide")
    spark.range(5).selectExpr(
        "'Fe2O3' as composition", "'0.1' as total_magnetization_normalized_vol", "id > 2 as is_magnetic", "id as unused"
    ).write.parquet(path)
    plan = clean_export(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(is_magnetic,true)" in plan
    assert "ReadSchema" in plan and "unused" not in plan and "Exchange" not in plan


def test_dimensions_are_read_by_name(spark, tmp_path):
    (tmp_path / "elements.csv").write_text(
        "atomic_number,valence,symbol,group_block,melting_point,period,atomic_weight,electronegativity,remark\n"
        "26,8,Fe,Group 8,1811,4,55.8,1.83 (Pauling),x\n27,9,Co,Group 9,1768,4,58.9,1.88,y\n22,4,Ti,Group 4,1941,4,47.9,1.54,z\n"
    )
    (tmp_path / "pairs.csv").write_text("Fe,Co,element,Al\n,-1.5,Fe,-9\n,,Co,-7\n,,Al,\n")
    elements, pairs = jobs.load_dimensions(spark, str(tmp_path / "elements.csv"), str(tmp_path / "pairs.csv"))
    rows = {r.symbol: r for r in elements.collect()}
    assert rows["Fe"].atomic_weight == 55.8 and rows["Fe"].valence == 8 and rows["Co"].electronegativity == "1.88"
    found = {(r.a, r.b): r.h for r in pairs.collect()}
    assert found["Fe", "Co"] == found["Co", "Fe"] == -1.5
    assert found["Al", "Fe"] == -9 and found["Co", "Al"] == -7
    # Ti is in the element table only: its pairs are absent, not zero.
    assert not any("Ti" in pair for pair in found)


@pytest.mark.parametrize("text", ["element,Fe\nFe,\nCo,1\n", "element,Fe,Co\nFe,1,\n", "x,Fe\nFe,1\n"])
def test_incomplete_pair_matrix(spark, tmp_path, text):
    (tmp_path / "pairs.csv").write_text(text)
    with pytest.raises(ValueError):
        dimensions.read_pair_matrix(spark, str(tmp_path / "pairs.csv"))


def test_element_table_without_a_column(spark, tmp_path):
    (tmp_path / "elements.csv").write_text("symbol,period\nFe,4\n")
    with pytest.raises(ValueError, match="atomic_weight"):
        dimensions.read_elements(spark, str(tmp_path / "elements.csv"))


def test_document_shapes(spark):
    texts = [
        '{"properties":{"chemistry":{"chemical formula":"Fe3B1","magnetic order":{"value":"FM"}},"crystal":{"lattice angles":{"value":90}},'
        '"magnetics":{"curie temperature":{"value":7,"unit":"K"},"remanence":1.5}}}',
        '{"properties":{"chemistry":{"chemical formula":{"value":"Co"}}}}',
        '{"properties":{}} trailing',
        '{"properties":{}}{"properties":{}}',
        '{"properties":{"magnetics":{"remanence":{"value":.5}}}}',
        "",
    ]
    docs = documents.parse_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, doc string"), "doc", ["i"])
    assert [r.i for r in documents.quarantined_documents(docs).orderBy("i").collect()] == [2, 3, 4, 5]
    rows = documents.retype(documents.flatten_documents(docs, ["i"])).orderBy("i").collect()
    assert rows[0]["chemical formula"] == "Fe3B1" and rows[0]["magnetic order"] == "FM" and rows[0]["remanence"] == 1.5
    assert rows[0]["lattice angles"] is None and rows[0]["curie temperature"] is None
    assert rows[1]["chemical formula"] == "Co" and rows[1]["magnetic order"] is None
