"""Training data, models and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import learn as L
from ..operators import raster, regions
from ..plans import segment as S
from ..session import cut_lineage
from ..sources.tables import H, W, pixels, table
from .base import query
from .baselines import rounded
from .detect import _HL, _HO, _HW, _SEG, _res
from .files import _state_folder
from .rasters import dense
from .scalars import PXC

C = F.col
_AUTO = """case when v/255 > 0.8 and s/255 < 0.3 then 'wave' when d1 > 1.3 and b > 50 and i > 180 then 'wave' when d1 > 1.3 and b > 50 then 'ocean'
  when s/255 < 0.2 and i > 50 and i < 150 then 'rock' else 'land' end"""
_AL = f"(select *, {_AUTO} as auto from (select *, (r+g+b)/3e0 as i, case when r>0 or g>0 then b/(greatest(r,g)+1e0) else 0 end as d1 from {PXC}))"


@query("auto_label", f"select frame, y, x, auto as label from {_AL}")
def auto_label(spark, sf):
    return S.auto_label(pixels(spark, sf)).select("frame", "y", "x", "label")


@query("sample_grid", "select frame, y, x from px where y >= 2 and y < 6 and x >= 2 and x < 6 and (y-2) % 3 = 0 and (x-2) % 3 = 0")
def sample_grid(spark, sf):
    return L.sample_grid(pixels(spark, sf), 3, 2, W, H).select("frame", "y", "x")


@query(
    "position_gradient_features",
    f"""select frame, y, x, round(gray,6) as gray, round(case when x = 0 then lead(gray) over wx - gray when x = 7 then gray - lag(gray) over wx else (lead(gray) over wx - lag(gray) over wx)/2 end,6) as gradient_x,
      round(case when y = 0 then lead(gray) over wy - gray when y = 7 then gray - lag(gray) over wy else (lead(gray) over wy - lag(gray) over wy)/2 end,6) as gradient_y,
      x/8e0 as fx, y/8e0 as fy from (select *, 0.2989e0*r+0.5870e0*g+0.1140e0*b as gray from px) window wx as (partition by frame, y order by x), wy as (partition by frame, x order by y)""",
)
def position_gradient(spark, sf):
    p = dense(spark, sf).withColumn("gray", colour.luminance(C("r"), C("g"), C("b")))
    d = raster.central_difference(p, "gray", ["frame"])
    return rounded(d.select("frame", "y", "x", "gray", "gradient_x", "gradient_y", (C("x") / float(W)).alias("fx"), (C("y") / float(H)).alias("fy")))


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", array_to_vector(C("embedding").cast("array<double>")).alias("features"))


@query(
    "standardise",
    """select vec_id, dim, round((v - avg(v) over (partition by dim))/stddev_pop(v) over (partition by dim),5) as z
      from (select vec_id, unnest(range(64)) as dim, unnest(embedding)::double as v from embeddings)""",
)
def standardise(spark, sf):
    d = L.standardise(vectors(spark, sf))
    return d.select("vec_id", F.posexplode(vector_to_array("features")).alias("dim", "z")).select("vec_id", "dim", F.round("z", 5).alias("z"))


@query(
    "split_stratified",
    """select vec_id, label, row_number() over (partition by label order by (vec_id*2654435761+42) % 2147483648, vec_id) - 1
      < floor(count(*) over (partition by label) * 0.8e0) as train from embeddings""",
)
def split_stratified(spark, sf):
    return L.split_stratified(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label")


_REP = f"(select auto as t, case surface when 'waves' then 'wave' else surface end as g from {_AL} join (select frame, y, x, surface from ({_SEG})) using (frame, y, x))"


@query(
    "classification_report",
    f"""select label, count(*) filter (t = label) as support, round(coalesce(count(*) filter (t = label and g = label)/nullif(count(*) filter (g = label), 0)::double,0),6) as precision,
      round(coalesce(count(*) filter (t = label and g = label)/nullif(count(*) filter (t = label), 0)::double,0),6) as recall, round(any_value(acc),6) as accuracy
      from {_REP}, (select unnest(['ocean','land','rock','wave']) as label), (select avg((t=g)::int) as acc from {_REP}) group by label""",
)
def classification_report(spark, sf):
    """Rule classes against the colour heuristics."""
    d = S.by_rules(S.auto_label(pixels(spark, sf)).drop("h", "s", "v"))
    d = d.withColumn("guess", F.when(C("surface") == "waves", "wave").otherwise(C("surface")))
    return rounded(L.report(d, "label", "guess"))


def _acc_sql(surface):
    return f"(select avg((auto = case {surface} when 'waves' then 'wave' else {surface} end)::int) from {_AL})"


@query(
    "best_model",
    f"""select arg_max(model, acc) as model, round(max(acc),6) as accuracy from (select 'rules' as model, (select avg((t=g)::int) from {_REP}) as acc
      union all select 'hsv' as model, (select avg(coalesce(auto = case su when 'waves' then 'wave' else su end, false)::int) from (select auto, {_res(_HO, _HL, _HW)} as su from {_AL})) as acc)""",
)
def best_model(spark, sf):
    p = S.auto_label(pixels(spark, sf)).drop("h", "s", "v")
    rows = None
    for name, f in (("rules", S.by_rules), ("hsv", S.by_hsv)):
        s = F.when(C("surface") == "waves", "wave").otherwise(C("surface"))
        r = f(p).agg(F.avg(F.coalesce(C("label") == s, F.lit(False)).cast("int")).alias("accuracy")).select(F.lit(name).alias("model"), "accuracy")
        rows = r if rows is None else rows.union(r)
    return rounded(L.best(rows))


# ---- models ------------------------------------------------------------------------------------
# All at their full sizes. What a fit yields has no SQL, but its rows do: how many it learned from and was tested on,
# and that it does better than always naming the commonest class.


def training(spark, sf):
    """Grid samples of every frame with heuristic labels, split by class; too few are refused."""
    px = S.auto_label(L.sample_grid(pixels(spark, sf), 3, 2, W, H)).drop("h", "s", "v")
    d, cols = L.pixel_features(px)
    d = L.assemble(d.withColumn("target", L.class_index()).withColumn("key", C("frame") * 64 + C("y") * 8 + C("x")), cols)
    d = L.split_stratified(d.select("key", "label", "target", "features"), "key", "label")
    d = L.guard_samples(cut_lineage(L.dealt(d, "key")))
    return d.filter("train"), d.filter("not train"), cols


_SPLIT = f"""(select *, row_number() over (partition by auto order by ((frame*64+y*8+x)*2654435761+42) % 2147483648, frame*64+y*8+x) - 1 < floor(count(*) over (partition by auto) * 0.8e0) as train
  from {_AL} where y in (2, 5) and x in (2, 5))"""
_TRAINED = f"select '{{0}}' as model, count(*) filter (train) as train_rows, count(*) filter (not train) as test_rows, true as beats_majority from {_SPLIT}"


def checked(name, tr, te, predicted):
    """Rows learned from and tested on, and whether the model beats the commonest class of the test rows."""
    most = te.groupBy("target").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share")).scalar()
    ok = L.accuracy(predicted).select((C("accuracy") > most).alias("beats_majority"))
    n = tr.agg(F.count(F.lit(1)).alias("train_rows")).crossJoin(te.agg(F.count(F.lit(1)).alias("test_rows")))  # one row each
    return n.crossJoin(ok).select(F.lit(name).alias("model"), "train_rows", "test_rows", "beats_majority")


@query("train_forest", _TRAINED.format("forest"))
def train_forest(spark, sf):
    tr, te, _ = training(spark, sf)
    return checked("forest", tr, te, L.forest(balanced=True).fit(L.balanced_weights(tr)).transform(te))


@query("train_boosted", _TRAINED.format("boosted"))
def train_boosted(spark, sf):
    tr, te, _ = training(spark, sf)
    return checked("boosted", tr, te, L.boosted().fit(tr).transform(te))


@query("train_mlp", _TRAINED.format("mlp"))
def train_mlp(spark, sf):
    tr, te, cols = training(spark, sf)
    return checked("mlp", tr, te, L.perceptron(len(cols)).fit(tr).transform(te))


@query("soft_vote", _TRAINED.format("vote"))
def soft_vote(spark, sf):
    tr, te, cols = training(spark, sf)
    return checked("vote", tr, te, L.soft_vote([L.forest().fit(tr), L.perceptron(len(cols)).fit(tr)], te))


@query("cross_validate", f"select 5 as folds, count(*) filter (train) as rows, true as beats_majority, true as steady from {_SPLIT}")
def cross_validate(spark, sf):
    """Five folds of the full forest: better than the commonest class, and alike from fold to fold."""
    tr, _, _ = training(spark, sf)
    most = tr.groupBy("target").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share")).scalar()
    d = L.cross_validate(tr, L.forest(), folds=5)
    n = tr.agg(F.count(F.lit(1)).alias("rows"))
    return n.crossJoin(d).select(F.lit(5).alias("folds"), "rows", (C("mean_accuracy") > most).alias("beats_majority"), (C("std_accuracy") < 0.1).alias("steady"))


@query("compare_models", f"select unnest(['forest', 'forest_deep', 'mlp']) as model, true as beats_majority")
def compare_models(spark, sf):
    tr, te, cols = training(spark, sf)
    most = te.groupBy("target").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share")).scalar()
    d = L.compare(tr, te, {"forest": L.forest(), "forest_deep": L.forest(200, 15), "mlp": L.perceptron(len(cols))})
    return d.select("model", (C("accuracy") > most).alias("beats_majority"))


@query("upgrade_model", "select * from (values (1, 'stump', true, 1), (2, 'forest', true, 2), (3, 'stump', false, 2)) t(step, candidate, promoted, version)")
def upgrade_model(spark, sf):
    """A first model, a better one that takes its place, and a worse one that is refused."""
    tr, te, _ = training(spark, sf)
    registry = L.Registry(spark, _state_folder(spark))
    stump, full = (Pipeline(stages=[e]).fit(tr) for e in (L.forest(1, 1), L.forest()))
    steps = [registry.upgrade(n, m, te) for n, m in (("stump", stump), ("forest", full), ("stump", stump))]
    rows = [(i + 1, x["candidate"], x["promoted"], x["version"]) for i, x in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, candidate string, promoted boolean, version int")


@query("feature_importance", "select 16 as n_features, true as sums_to_one, true as none_negative")
def feature_importance(spark, sf):
    tr, _, cols = training(spark, sf)
    d = L.importances(L.forest().fit(tr), cols, spark)
    return d.agg(F.count(F.lit(1)).cast("int").alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"), (F.min("importance") >= 0).alias("none_negative"))


@query("classify_pixels", "select count(distinct frame) as frames, count(*) as pixels, true as agrees from px")
def classify_pixels(spark, sf):
    """Model classes on half-resolution pixels, expanded back; rock counts as land; largest ocean kept.

    Every pixel has a class, and the ocean kept is part of what the model called ocean.
    """
    tr, _, cols = training(spark, sf)
    model = L.forest().fit(tr)
    small = raster.downsample(dense(spark, sf), ["r", "g", "b"], ["frame"], 2)
    d, _ = L.pixel_features(small)
    c = model.transform(L.assemble(d, cols)).select("frame", "y", "x", "prediction")
    full = raster.upsample_nearest(c, ["frame"], 2, W, H)
    ocean = full.filter(C("prediction") == 0).select("frame", "y", "x")
    big = regions.largest_component(regions.remove_small_objects(ocean, ["frame"], W, 3), ["frame"], W, H, 0.05)
    kept = full.join(big.withColumn("kept", F.lit(True)), ["frame", "y", "x"], "left")
    return kept.agg(F.count_distinct("frame").alias("frames"), F.count(F.lit(1)).alias("pixels"), F.min((C("kept").isNull()) | (C("prediction") == 0)).alias("agrees"))


@query("save_model", f"select count(*) filter (not train) as rows, true as same from {_SPLIT}")
def save_model(spark, sf):
    """A model read back predicts what it predicted before."""
    tr, te, _ = training(spark, sf)
    path = _state_folder(spark)
    model = Pipeline(stages=[L.forest()]).fit(tr)
    L.save_model(model, path)
    both = model.transform(te).select("key", "prediction").join(PipelineModel.load(path).transform(te).select("key", C("prediction").alias("again")), "key")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.min(C("prediction") == C("again")).alias("same"))


@query("save_training", "select label, count(*) as n from (select auto as label from {al} where y >= 2 and y < 6 and x >= 2 and x < 6 and (y-2) % 3 = 0 and (x-2) % 3 = 0) group by label".format(al=_AL))
def save_training(spark, sf):
    path = _state_folder(spark)
    S.auto_label(L.sample_grid(pixels(spark, sf), 3, 2, W, H)).select("frame", "y", "x", "label").write.parquet(path)
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
