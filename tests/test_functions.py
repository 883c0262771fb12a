from pyspark.sql import functions as F

from gridloom.functions import text as fx
from gridloom.operators.numbering import display_digits
from gridloom.sources.tables import unique_names


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_terms(spark):
    texts = ["iron <CHEBI:1>", "<X:2>", "plain", "", None, "  a b  < Y:3 > "]
    assert column(spark, texts, fx.term_id_of("v")) == ["CHEBI:1", "X:2", None, None, None, "Y:3"]
    assert column(spark, texts, fx.term_name_of("v")) == ["iron", None, "plain", None, None, "a b"]


def test_references(spark):
    refs = ["Sample:S:1", " Generic : b", "Brick-12:B1", "nocolon", None]
    assert column(spark, refs, fx.ref_type("v")) == ["Sample", "Brick", "Brick-12", "nocolon", None]
    assert column(spark, refs, fx.ref_key("v")) == ["S:1", "b", "B1", None, None]
    assert column(spark, refs, fx.ref_table("v"))[:3] == ["sdt_sample", "ddt_ndarray", "ddt_ndarray"]


def test_object_lists(spark):
    texts = ['A: 1, "B: x, y",C: 3', "", None, '"A: ""q"""']
    out = column(spark, texts, fx.split_object_list("v"))
    assert out[0] == ["A: 1", "B: x, y", "C: 3"]
    assert out[1] == []
    assert out[2] is None


def test_arrays(spark):
    assert column(spark, ["[a, b]", "[]", "", None, "[x]"], fx.parse_array("v")) == [["a", "b"], [], [], [], ["x"]]
    assert column(spark, [["a", "b"], None], fx.format_value_list("v"), "array<string>") == ["[a, b]", ""]
    assert column(spark, [{"k": "v", "a": None}], fx.format_value_map("v"), "map<string,string>") == ["{a: , k: v}"]


def test_missing_values(spark):
    assert column(spark, ["null", "NaN", "", " x", None, "-"], fx.null_text("v")) == [None, None, None, " x", None, "-"]
    assert column(spark, ["-", "n/a", "N/A", "0"], fx.null_text("v", fx.GRID_NULL_TEXTS)) == [None, None, None, "0"]


def test_scalars(spark):
    assert column(spark, ["yes", "TRUE", "0", "YES", None], fx.normalize_boolean("v")) == [1, 1, 0, None, None]
    assert column(spark, ["1", "1.5", "x", None], fx.cast_scalar("v", "int")) == [1, None, None, None]
    assert column(spark, ["1", "1e3", "NaN", "x"], fx.cast_scalar("v", "float")) == [1.0, 1000.0, None, None]
    assert column(spark, [1, 10, 999, 1000], fx.line_thickness("v"), "int") == [1, 2, 4, 4]


def test_names(spark):
    assert column(spark, ["  Sample Name-2 (m)", "A__b"], fx.normalize_name("v")) == ["sample_name_2_m", "a_b"]
    assert column(spark, ["Sample0000012", "TnSeq_Library1", "12"], fx.to_object_type("v")) == ["Sample", "TnSeq_Library", ""]
    assert unique_names(["a", "b", "a", "a", "b"]) == ["a", "b", "a_2", "a_3", "b_2"]


def test_labels(spark):
    df = spark.createDataFrame([("x", None)], "v1 string, v10 string")
    assert df.select(fx.fill_label("#V10/#V1", {"#V1": "v1", "#V10": "v10"})).first()[0] == "N/A/x"
    assert df.select(fx.concat_dim_values("v1", "v10")).first()[0] == "x, N/A"
    attrs = F.array(F.lit("state = wet"))
    assert df.select(fx.long_name(F.lit("Iron"), attrs, F.lit("mg/L"))).first()[0] == "Iron : state = wet (mg/L)"
    assert df.select(fx.long_name(F.lit("Iron"), F.lit(None).cast("array<string>"), F.lit(None))).first()[0] == "Iron"


def test_truncated_lists(spark):
    long = [str(i) for i in range(12)]
    assert column(spark, [long, long[:10]], fx.truncate_list("v"), "array<string>") == [[*long[:9], "and 3 more"], long[:10]]


def test_display_digits(spark):
    assert column(spark, [0.5, 0.01, 2.0, 1e-9, 0.0003, 12.25], display_digits(F.col("v")), "double") == [0, 1, 0, 9, 3, 0]
