import pytest
from pyspark.sql import functions as F

from limpid.operators import dependencies as fd
from limpid.operators import outliers, profile, rules, sampling, scoring, spelling
from limpid.plans import cleaning, export, sql_program, supplied
from limpid.sources.datasets import Settings
from limpid.streaming.profiles import latest_steps

TINY = [(0, "177", "Gary"), (1, "177", "Gary"), (2, "177", "Gary IN"), (3, "408", "Bend"), (4, "408", None)]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, "rid int, brewery_id string, city string")


def test_issues(tiny):
    assert [tuple(r) for r in fd.issues(tiny, [("brewery_id", "city")]).collect()] == [("brewery_id", "city", 1, 1)]


def test_purity_and_conflicts(tiny):
    assert {(r["lhs"], r["rhs"]): r["score"] for r in fd.score_pairs(tiny, ["brewery_id"], ["city"]).collect()} == {("brewery_id", "city"): 0.75}
    assert [tuple(r) for r in fd.conflicts(tiny, "rid", "brewery_id", "city").collect()] == [("177", "Gary (2), Gary IN (1)")]
    assert [r["rid"] for r in fd.imputable_rows(tiny, "brewery_id", "city").collect()] == [4]


def test_enforcement(tiny):
    out = {r["rid"]: r["city"] for r in fd.enforce(tiny, "rid", "brewery_id", "city").collect()}
    assert out == {0: "Gary", 1: "Gary", 2: "Gary", 3: "Bend", 4: "Bend"}


def test_no_rows(spark):
    none = spark.createDataFrame([], "rid int, a string, b string")
    assert fd.detect(none, "rid", ["a", "b"]).count() == 0
    assert [r["score"] for r in fd.score_pairs(none, ["a"], ["b"]).collect()] == [0.0]
    assert {r["semantic_type"] for r in profile.semantic_types(profile.value_counts(none, "rid", ["a", "b"]), ["a", "b"]).collect()} == {"EMPTY"}


def test_order_of_enforcement():
    chain = [("b", "c", 0.9), ("a", "b", 0.95), ("x", "y", 0.99)]
    assert [{d[:2] for d in level} for level in fd.enforcement_order(chain)] == [{("a", "b"), ("x", "y")}, {("b", "c")}]
    cycle = [("a", "b", 0.99), ("b", "a", 0.95), ("b", "c", 0.93)]
    assert [[d[:2] for d in level] for level in fd.enforcement_order(cycle)] == [[("a", "b")], [("b", "c")]]


def test_semantic_types(spark):
    rows = [(i, str(i % 2), f"{i}.5" if i % 10 == 0 else str(i), "yes" if i % 2 else "no", None, f"{i} kg", "a;b", "  ") for i in range(40)]
    columns = ["bits", "mixed", "flag", "none", "weight", "list", "blank"]
    df = spark.createDataFrame(rows, "rid int, bits string, mixed string, flag string, none string, weight string, list string, blank string")
    got = {r["column"]: r["semantic_type"] for r in profile.semantic_types(profile.value_counts(df, "rid", columns), columns).collect()}
    assert got == {"bits": "BOOLEAN", "mixed": "FLOAT", "flag": "BOOLEAN", "none": "EMPTY", "weight": "DIRTY_INTEGER", "list": "DELIMITED_STRING", "blank": "EMPTY"}


def test_histogram_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(5.0,)] * 3, "v double")
    got = profile.histogram(one, "v").collect()
    assert len(got) == 16 and sum(r["n"] for r in got) == 3
    assert profile.histogram(one.where("v > 9"), "v").count() == 0


def test_broad_shapes(spark):
    words = spark.createDataFrame([(i, "abcdefghij"[: i % 10 + 1]) for i in range(40)], "rid int, v string")
    assert [r["pattern"] for r in profile.shapes(words, "rid", "v").collect()] == ["^[A-Za-z]{1,10}$"]


def test_outliers(spark):
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate([10, 11, 12, 9, 10, 11, 10, 12, 9, 500, 500, "x", None])], "rid int, v string")
    assert [tuple(r) for r in outliers.outliers(df, "rid", "v").collect()] == [(500.0, 2, 9)]
    assert {r["rid"] for r in outliers.outlier_context(df, "rid", "v").collect()} == {9, 10}
    assert outliers.outliers(df.limit(5), "rid", "v").count() == 0


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "rid").withColumn("v", F.when(F.col("rid") % 3 == 0, None).otherwise(F.col("rid").cast("string")))
    one, again = ([r["rid"] for r in sampling.sample(df, "rid", 50, "7|a").collect()] for _ in range(2))
    other = [r["rid"] for r in sampling.sample(df.repartition(7), "rid", 50, "7|b").collect()]
    assert one == again and len(set(one)) == 50 and set(one) != set(other)
    assert sampling.sample(df, "rid", 5000, "x").count() == 1000
    rows = sampling.profile_rows(spark.range(5000).withColumnRenamed("id", "rid").withColumn("v", F.when(F.col("rid") > 50, "x")), "rid")
    assert rows.count() == 1000 and rows.where("v is null").count() == 0


def test_review_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "rid")
    got = sampling.review_sample(df, "rid", F.col("rid") < 200, "1").groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in got} == {"changed": 90, "random": 60}
    assert sampling.review_sample(df, "rid", F.lit(False), "1").count() == 150


def _scored(spark, schema, dirty, cleaned, truth):
    make = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"rid int, {schema}")
    cells = scoring.masks(make(dirty), make(cleaned), make(truth), "rid")
    return {r["column"]: r for r in scoring.scores(scoring.counts(cells)).collect()}, {r["column"]: r for r in scoring.dashboard(scoring.counts(cells)).collect()}


def test_metrics(spark):
    dirty = [("1O", "Anna"), ("2", "bram"), ("x", None), (None, "Dirk"), ("5", "eva")]
    truth = [("10", "Anna"), ("2", "Bram"), ("3", "Cees"), (None, "Dirk"), ("5", "Eva")]
    cleaned = [("10", "Anna"), ("2", "Bram"), ("3", None), (None, "Dirk"), ("5", "Eva")]
    scores, shown = _scored(spark, "a string, b string", dirty, cleaned, truth)
    s = scores[None]
    assert (s["tp"], s["fp"], s["tn"], s["fn"]) == (4, 0, 5, 1)
    assert (shown[None]["cell_accuracy"], shown[None]["repair_precision"], shown[None]["repair_recall"]) == (0.9, 1.0, 0.8)
    assert round(shown[None]["repair_f1"], 4) == 0.8889 and round(shown["b"]["repair_f1"], 4) == 0.8 and (scores["b"]["tp"], scores["b"]["fn"]) == (2, 1)


def test_wrong_fix_and_nothing_to_do(spark):
    scores, shown = _scored(spark, "a string", [("1O",), ("x",), ("3",)], [("10",), ("y",), ("3",)], [("10",), ("2",), ("3",)])
    assert (scores[None]["tp"], scores[None]["repaired"], shown[None]["repair_precision"]) == (2, 1, 0.5)
    scores, shown = _scored(spark, "a string", *[[("x",), ("y",)]] * 3)
    assert scores[None]["detection_f1"] == 0.0 and shown[None]["repair_f1"] is None and shown[None]["repair_precision"] is None and shown[None]["cell_accuracy"] == 1.0


def test_shapes_have_to_agree(spark):
    with pytest.raises(ValueError):
        scoring.same_shape(spark.range(3), spark.range(4))


def test_rules(spark):
    df = spark.createDataFrame([("1.234,5", "TRUE ", "a ,b;c", "['x', NA]", "12 kg"), ("1,234.50", "fasle", "a", "[NA]", "12 kg, 45cm"), ("12%", "maybe", "", "broken", "kg"), (None, None, None, None, None)], "n string, b string, d string, c string, u string")
    got = [tuple(r) for r in df.select(rules.plain_number(F.col("n")), rules.booleans(F.col("b")), rules.delimited(F.col("d")), rules.collections(F.col("c")), rules.unit_stripped(F.col("u"), "kg")).collect()]
    assert got == [(1234.5, "true", "a, b, c", '["x"]', "12"), (1234.5, None, "a", "[]", "12 kg, 45cm"), (12.0, None, "", None, "kg"), (None, None, None, None, None)]


def test_dates_take_the_common_form(spark):
    df = spark.createDataFrame(list(enumerate(["2020-01-05", "2020-02-06", "7 March 2020", "2020/04/08", "2020-13-40", "soon", None])), "rid int, d string")
    form = rules.dominant(df, rules.date_format_of(F.col("d")), "rid")
    assert form == "yyyy-MM-dd"
    assert [r[0] for r in df.select(rules.dates(F.col("d"), form)).collect()] == ["2020-01-05", "2020-02-06", "2020-03-07", "2020-04-08", None, None, None]


def test_spelling(spark):
    df = spark.createDataFrame(list(enumerate(["Utrecht"] * 6 + ["Utrect", "utrecht ", "Delft", "Utrxxht"])), "rid int, v string")
    found = spelling.spelling_map(df, "v", "rid")
    assert {r["value"]: r["canonical"] for r in found.collect()} == {"Utrect": "Utrecht", "utrecht ": "Utrecht"}
    assert spelling.respelled(df, "v", found).where("v = 'Utrecht'").count() == 8


def dirty_table(spark):
    rows = [(i, f"B{i % 5}", None if i == 7 else "Citty" if i == 11 else f"City{i % 5}", f"{i % 5}.0 oz", "x", None) for i in range(60)]
    return spark.createDataFrame(rows, "rid int, code string, city string, size string, keep string, none string")


def test_cleaning_a_table(spark):
    out, report = cleaning.clean_table(dirty_table(spark), "rid", Settings(clean_columns=("keep",)))
    rows = {r["rid"]: r for r in out.collect()}
    assert rows[7]["city"] == "City2" and rows[11]["city"] == "City1" and rows[3]["size"] == 3.0
    steps = {s.target: s.outcome for s in report.steps}
    assert steps["keep"] == steps["none"] == "skipped" and steps["size"] == "cleaned" and any("→" in t for t in steps)
    assert report.to_df(out).count() == len(report.steps)


def test_a_failing_cleaner_stops_nothing(spark):
    def cleaner(df, column, kind):
        if column == "city":
            raise RuntimeError("no")
        return F.lit(None).cast("string") if column == "code" else None

    out, report = cleaning.clean_table(dirty_table(spark), "rid", cleaner=cleaner)
    steps = {s.target: s.outcome for s in report.steps}
    assert (steps["city"], steps["code"], steps["size"]) == ("failed", "rejected", "already clean") and out.where("code is null").count() == 0


def test_supplied_function(spark):
    df = spark.createDataFrame([(0, " a "), (1, None)], "rid int, v string")
    assert [r["v"] for r in supplied.apply_series_cleaner(df, "v", lambda s: s.str.strip(), "rid").orderBy("rid").collect()] == ["a", None]
    with pytest.raises(Exception, match="as long as"):
        supplied.apply_series_cleaner(df, "v", lambda s: s.head(0), "rid").collect()


def test_export_repeats_the_run(spark, tmp_path):
    _, report = cleaning.clean_table(dirty_table(spark), "rid")
    code = export.script("a_dirty.csv", str(tmp_path), "rid", report)
    compile(code, "script", "exec")
    book = export.notebook("a_dirty.csv", "out", "rid", report, 3)
    assert book["nbformat"] == 4 and book["nbformat_minor"] == 5 and "3 cells changed" in "".join(book["cells"][0]["source"])
    assert export.identifier("Unit price (€)") == "unit_price"


def test_sql_program(spark):
    df = spark.createDataFrame([(1, " brand#3", "5 kg", "Y"), (2, "unknown", "N/A", "maybe")], "p_partkey int, brand_text string, size_text string, flag_text string")
    assert [(r["p_partkey"], r["brand"], r["flag"]) for r in sql_program.run(df, sql_program.BRANDS).collect()] == [(1, "Brand#3", True), (2, None, None)]


def test_last_writer_wins(spark):
    trace = spark.createDataFrame([("a", "coder_1", "running", None, 1), ("a", "coder_1", "ok", "x", 2), ("b", "finished", "ok", None, 1)], "column string, step string, status string, note string, at long")
    assert {(r["column"], r["status"]) for r in latest_steps(trace).collect()} == {("a", "ok"), ("b", "ok")}
