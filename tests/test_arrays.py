import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import bricks as bk
from gridloom.operators import numbering
from gridloom.operators.bricks import Brick, Dim
from gridloom.operators import pca
from gridloom.operators.pca import CellPca, Pca, PcaModel, rows_to_arrays
from gridloom.plans import slices


@pytest.fixture(scope="module")
def cube(spark):
    """2 places x 3 metals x 2 replicates; one value is NaN, one cell is missing."""
    values = np.arange(12, dtype=float).reshape(2, 3, 2)
    values[0, 1, 1] = np.nan
    rows = [(i, j, k, float(values[i, j, k])) for i in range(2) for j in range(3) for k in range(2) if (i, j, k) != (1, 2, 1)]
    values[1, 2, 1] = np.nan
    place = spark.createDataFrame([(0, "north", 1.0), (1, "south", 1.0)], "idx int, place string, depth double")
    metal = spark.createDataFrame([(0, "Co", "light"), (1, "Ni", "heavy"), (2, "Pb", "heavy")], "idx int, metal string, class string")
    rep = spark.createDataFrame([(0, "r1"), (1, "r2")], "idx int, rep string")
    dims = (Dim("Place", place, ("place", "depth")), Dim("Metal", metal, ("metal", "class")), Dim("Replicate", rep, ("rep",)))
    return Brick("cube", "Metals", dims, spark.createDataFrame(rows, "i1 int, i2 int, i3 int, v double"), ("v",)), values


def test_mean_skips_missing_values(cube):
    b, values = cube
    out = {(r["i1"], r["i2"]): r["v"] for r in b.mean(2).cells.collect()}
    with np.errstate(all="ignore"):
        want = np.nanmean(values, axis=2)
    assert out == pytest.approx({(i, j): want[i, j] for i in range(2) for j in range(3)})


def test_mean_over_everything_of_a_full_array_is_the_global_mean(spark):
    cells = bk.create_cells(spark, [3, 4]).withColumn("v", (F.col("i1") * 7 + F.col("i2")).cast("double"))
    dims = tuple(Dim(n, spark.range(s).select(F.col("id").alias("idx"), F.col("id").alias("x")), ("x",)) for n, s in (("A", 3), ("B", 4)))
    b = Brick("x", "X", dims, cells, ("v",))
    assert b.mean(0).mean(0).cells.first()["v"] == pytest.approx(cells.agg(F.avg("v")).first()[0])


def test_where_renumbers_and_keeps_the_old_index(cube):
    b, _ = cube
    out = b.where(b.dim_mask(1, "class", "==", "heavy"))
    assert sorted((r["idx"], r["metal"], r["orig_idx"]) for r in out.dims[1].df.collect()) == [(0, "Ni", 1), (1, "Pb", 2)]
    assert {r["i2"] for r in out.cells.collect()} == {0, 1}
    again = out.where(out.dim_mask(1, "metal", "==", "Pb"))
    assert [(r["idx"], r["orig_idx"]) for r in again.dims[1].df.collect()] == [(0, 2)]
    assert [name for name, _ in again.ops] == ["where", "where"]


def test_select_drops_the_fixed_dimension(cube):
    b, values = cube
    out = b.select("south", None, {"rep": "r1"})
    assert {r["i1"]: r["v"] for r in out.cells.collect()} == {j: values[1, j, 0] for j in range(3)}
    assert [(a.type_term, a.value) for a in out.attrs] == [("place", "south"), ("depth", 1.0), ("rep", "r1")]


def test_masks_of_different_dimensions_do_not_mix(cube):
    b, _ = cube
    with pytest.raises(ValueError, match="dimensions"):
        b.dim_mask(0, "depth", ">", 0) & b.dim_mask(1, "metal", "==", "Co")
    with pytest.raises(ValueError, match="arrays"):
        b.dim_mask(0, "depth", ">", 0) | b.mean(2).dim_mask(0, "depth", ">", 0)


def test_series_of_fixed_and_averaged_slices(cube):
    b, values = cube
    fixed = slices.filter_brick(b, {"constant": {"3": 1}, "variable": ["2/1", "1/1"]})
    out = {(r["label"], r["x"]): (r["y"], r["error_y"]) for r in fixed.collect()}
    assert out[("place = north", "Co")] == (0.0, None)
    assert len(out) == 6
    averaged = {(r["label"], r["x"]): (r["y"], r["error_y"]) for r in slices.filter_brick(b, {"variable": ["2/2", "1/1"]}).collect()}
    heavy = values[0, 1:, :].ravel()
    heavy = heavy[~np.isnan(heavy)]
    assert averaged[("place = north", "heavy")] == pytest.approx((heavy.mean(), heavy.std(ddof=1)))


def test_unknown_dimension_is_named(cube):
    b, _ = cube
    with pytest.raises(ValueError, match="Dimension index 7 invalid"):
        slices.filter_brick(b, {"variable": ["2", "7"]})
    with pytest.raises(ValueError, match="at least two"):
        slices.filter_brick(b, {"variable": ["2"], "z": True})


def test_fixed_variables_of_one_dimension_intersect(cube):
    b, _ = cube
    out = slices.fix_indices(b, {"2/2": 2, "2/1": 3})
    assert [r["idx"] for r in out[1].collect()] == [2]
    assert slices.fix_indices(b, {"2/2": 1, "2/1": 3})[1].count() == 0


def test_split_and_merge_undo_each_other(spark):
    wide = spark.createDataFrame([(0, 0, 1.0, None), (0, 1, None, 4.0), (1, 0, 5.0, 6.0)], "i1 int, i2 int, a double, b double")
    back = bk.long_to_wide(bk.wide_to_long(wide, ["i1", "i2"], ["a", "b"]), ["i1", "i2"], "i0", ["a", "b"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in wide.collect()}


def test_positions_match_numpy(spark):
    shape = [2, 3, 4]
    out = {r["id"]: (r["i1"], r["i2"], r["i3"]) for r in spark.range(24).select("id", *bk.unravel_index("id", shape)).collect()}
    assert out == {p: tuple(int(x) for x in np.unravel_index(p, shape)) for p in range(24)}


def test_numbering_by_slices_equals_plain_numbering(spark):
    rows = [("hot", i) for i in range(3000)] + [("a", 5), ("a", 1), (None, 2), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    plain = {tuple(r) for r in df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1).collect()}
    sliced = {tuple(r) for r in numbering.number_rows(df, ["k"], ["v"]).collect()}
    assert sliced == plain
    assert ("hot", 2999, 2999) in sliced and ("a", 1, 0) in sliced and (None, 2, 1) in sliced
    overall = numbering.number_rows(df.select("v").distinct(), [], ["v"])
    assert all(r["v"] == r["pos"] for r in overall.collect())


def test_smallest_gap(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.03,), (2.0,), (None,)], "v double")
    row = numbering.smallest_gap(df, "v").first()
    assert row["gap"] == pytest.approx(0.03) and row["digits"] == 1


def test_pca_matches_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(5)], "i1 int, i2 int, v double").repartition(4)
    model = PcaModel(rows_to_arrays(cells, "i1", "i2", "v"), "i1")
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt[:3]
    vt = vt * np.sign(vt[np.arange(3), np.abs(vt).argmax(axis=1)])[:, None]
    loadings = np.zeros((5, 3))
    for r in model.components().collect():
        loadings[r["feature"], r["component"] - 1] = r["loading"]
    assert loadings == pytest.approx(vt.T, abs=1e-8)
    scores = c @ vt.T
    scores = scores / scores.std(axis=0, ddof=1)
    got = np.zeros((60, 3))
    for r in model.scores().collect():
        got[r["i1"], r["component"] - 1] = r["score"]
    assert got == pytest.approx(scores, abs=1e-8)


def test_pca_gives_arrays(spark):
    cells = bk.create_cells(spark, [20, 4]).withColumn("v", F.sin(F.col("i1") * 1.7 + F.col("i2") * F.col("i1")))
    dims = tuple(Dim(n, spark.range(s).select(F.col("id").alias("idx"), F.col("id").alias("x")), ("x",)) for n, s in (("A", 20), ("B", 4)))
    pca = Pca()
    scores = pca.fit(Brick("b", "B", dims, cells, ("v",)))
    assert scores.cells.count() == 60 and pca.components_.cells.count() == 12
    assert {r["component"] for r in scores.dims[1].df.collect()} == {"PCA1", "PCA2", "PCA3"}
    with pytest.raises(ValueError, match="2 dimensions"):
        pca.fit(Brick("b", "B", dims[:1], cells, ("v",)))


def loadings_of(model, cols, k):
    out = np.zeros((cols, k))
    for r in model.components().collect():
        out[r["i2"], r["component"] - 1] = r["loading"]
    return out


@pytest.mark.parametrize("vectors", [64, 6])
def test_pca_of_sparse_wide_cells(spark, monkeypatch, vectors):
    """More columns than vectors, absent cells that stand for 2, and a spectrum that falls off."""
    monkeypatch.setattr(pca, "VECTORS", vectors)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 30)) @ np.diag(3.0 ** -np.arange(30)) @ rng.normal(size=(30, 30))
    kept = rng.random(x.shape) < 0.8
    x = np.where(kept, x, 2.0)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i, j in np.argwhere(kept).tolist()] + [(0, 0, None)] * 2, "i1 int, i2 int, v double").repartition(3)
    cells = cells.where("v IS NOT NULL OR i1 = 0")
    model = CellPca(cells, "i1", "i2", "v", whiten=False, fill=2.0)
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    sign = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])
    assert model.variances == pytest.approx(s[:3] ** 2 / 39, rel=1e-8)
    assert loadings_of(model, 30, 3) == pytest.approx((vt[:3] * sign[:, None]).T, abs=1e-5)
    got = np.zeros((40, 3))
    for r in model.scores().collect():
        got[r["i1"], r["component"] - 1] = r["score"]
    assert got == pytest.approx(c @ (vt[:3] * sign[:, None]).T, abs=1e-4)
    with pytest.raises(ValueError, match="absent"):
        CellPca(cells, "i1", "i2", "v")
    with pytest.raises(ValueError, match="more than once"):
        CellPca(cells.unionByName(cells.where("v IS NOT NULL").limit(1)), "i1", "i2", "v", fill=0.0)


def test_pca_of_every_variable(spark):
    cells = bk.create_cells(spark, [12, 4]).withColumns({"v": F.sin(F.col("i1") * 1.7 + F.col("i2") * F.col("i1")), "w": F.cos(F.col("i1") * F.col("i2") + F.col("i1"))})
    dims = tuple(Dim(n, spark.range(s).select(F.col("id").alias("idx")), ()) for n, s in (("A", 12), ("B", 4)))
    model = Pca()
    scores = model.fit(Brick("b", "B", dims, cells, ("v", "w")))
    assert scores.data_vars == model.components_.data_vars == ("v", "w") and scores.cells.count() == 36
    alone = {(r.i1, r.component - 1): r.score for r in CellPca(cells, "i1", "i2", "w").scores().collect()}
    assert {(r.i1, r.i2): r.w for r in scores.cells.collect()} == pytest.approx(alone)


def test_dimension_variables_from_entities(cube, spark):
    b, _ = cube
    sites = spark.createDataFrame([("S1", "north", 9.0), ("S2", "north", 8.0), ("S3", "east", 7.0)], "id string, name string, lat double")
    b = b.map_to_core_type(0, "place", sites, "name", "id", "site").add_core_type_var(0, "site", sites, "id", "lat")
    rows = {r["place"]: (r["site"], r["lat"]) for r in b.dims[0].df.collect()}
    assert rows == {"north": ("S2", 8.0), "south": (None, None)}
    linked = spark.createDataFrame([("S2", "x", 2), ("S2", "a", 1)], "id string, region string, n int")
    b = b.add_up_props(0, "site", linked, "id", ["region", "n"])
    assert {(r["place"], r["region"], r["n"]) for r in b.dims[0].df.collect()} == {("north", "a", 1), ("south", None, None)}
    assert b.dims[0].variables == ("place", "depth", "site", "lat", "region", "n")
    assert [name for name, _ in b.ops] == ["add_var"] * 4
