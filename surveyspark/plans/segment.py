"""Surface classes from colour rules or temperature; every rule set is a handful of Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.infrared import celsius
from ..operators import grids, raster, regions

C = F.col

# HSV limits (h in degrees, s and v in 0..255) of the three rule sets.
RULES = {
    "survey": {"ocean": (180, 250, 30, 40, 200), "wave_s": 25, "wave_v": 150, "dark": 82, "blue": 1.2, "dark_blue": 1.3},
    "ranges": {"ocean": (180, 250, 20, 20, 200), "land": (40, 150, 15, 10), "wave_s": 30, "wave_v": 180, "dark": 30},
}
TUNABLE = {
    "ocean_h_min": 180,
    "ocean_h_max": 250,
    "ocean_s_min": 20,
    "ocean_v_min": 30,
    "ocean_v_max": 200,
    "rock_v_max": 82,
    "rock_variance": 40,
    "wave_s_max": 25,
    "wave_v_min": 150,
    "blue_ratio": 1.20,
}


def with_hsv(px: DataFrame) -> DataFrame:
    return px.select("*", *[c.alias(n) for n, c in colour.hsv(C("r"), C("g"), C("b")).items()])


def with_lab(px: DataFrame) -> DataFrame:
    return px.select("*", *[c.alias(n) for n, c in colour.lab(C("r"), C("g"), C("b")).items()])


def _surface(ocean: Column, waves: Column) -> Column:
    return F.when(waves, "waves").when(ocean, "ocean").otherwise("land")


def by_rules(px: DataFrame, blue: float = 1.2) -> DataFrame:
    """Foam first, then dark rock that is not blue, then blue water; the rest is land."""
    k = RULES["survey"]
    h0, h1, s0, v0, v1 = k["ocean"]
    dom = colour.blue_dominance(C("r"), C("g"), C("b"))
    waves = (C("s") < k["wave_s"]) & (C("v") > k["wave_v"])
    dark = C("v") < k["dark"]
    water = C("h").between(h0, h1) & (C("s") >= s0) & C("v").between(v0, v1)
    deep = dark & (dom > k["dark_blue"]) & (C("b") > 30)
    ocean = (water | deep) & ~(dark & (dom < blue))
    return with_hsv(px).withColumn("surface", _surface(ocean, waves))


def tunable(px: DataFrame, p: dict = TUNABLE) -> DataFrame:
    dom = colour.blue_dominance(C("r"), C("g"), C("b"))
    waves = (C("s") < p["wave_s_max"]) & (C("v") > p["wave_v_min"])
    neutral = colour.colour_range(C("r"), C("g"), C("b")) < p["rock_variance"]
    rock = (C("v") < p["rock_v_max"]) & (neutral | (dom < p["blue_ratio"]))
    water = (
        C("h").between(p["ocean_h_min"], p["ocean_h_max"])
        & (C("s") >= p["ocean_s_min"])
        & C("v").between(p["ocean_v_min"], p["ocean_v_max"])
    )
    ocean = (water | ((dom > p["blue_ratio"]) & (C("b") > 20) & ~waves)) & ~rock
    return with_hsv(px).withColumn("surface", F.when(rock, "land").otherwise(_surface(ocean, waves)))


def _hsv_masks() -> tuple[Column, Column, Column]:
    k = RULES["ranges"]
    h0, h1, s0, v0, v1 = k["ocean"]
    lh0, lh1, ls0, lv0 = k["land"]
    ocean = C("h").between(h0, h1) & (C("s") >= s0) & C("v").between(v0, v1)
    land = (C("h").between(lh0, lh1) & (C("s") >= ls0) & (C("v") >= lv0)) | (C("v") < k["dark"])
    waves = (C("s") <= k["wave_s"]) & (C("v") >= k["wave_v"])
    return ocean, land, waves


def _lab_masks() -> tuple[Column, Column, Column]:
    ocean = (C("lb") < -5) & (C("l") > 20) & (C("l") < 80)
    land = ((C("a") < -5) & (C("lb") > -10)) | (C("l") < 30)
    waves = (C("l") > 85) & (F.abs("a") < 10) & (F.abs("lb") < 10)
    return ocean, land, waves


def _resolve(ocean: Column, land: Column, waves: Column) -> Column:
    """Waves beat land, land beats ocean; NULL where no rule speaks."""
    return F.when(waves, "waves").when(land, "land").when(ocean, "ocean")


def by_hsv(px: DataFrame) -> DataFrame:
    return with_hsv(px).withColumn("surface", _resolve(*_hsv_masks()))


def by_lab(px: DataFrame) -> DataFrame:
    return with_lab(px).withColumn("surface", _resolve(*_lab_masks()))


def by_vote(px: DataFrame) -> DataFrame:
    """Either colour space may claim ocean or land, both must agree on waves; strong colours count too."""
    h, l_ = _hsv_masks(), _lab_masks()
    r, g, b = C("r"), C("g"), C("b")
    final = lambda m: (m[0] & ~m[1] & ~m[2], m[1] & ~m[2], m[2])
    h, l_ = final(h), final(l_)
    ocean = h[0] | l_[0] | ((b > r * 1.2) & (b > g * 1.1) & (b > 50))
    land = h[1] | l_[1] | ((g > r * 1.1) & (g > b * 1.1) & (g > 30))
    return with_lab(with_hsv(px)).withColumn("surface", _resolve(ocean, land, h[2] & l_[2]))


def by_hsv_aligned(px: DataFrame) -> DataFrame:
    """HSV rules, then whichever of blue and green dominates decides the undefined rest."""
    s = _resolve(*_hsv_masks())
    fill = F.when(C("b") > C("g") * 1.1, "ocean").when(C("g") > C("b") * 1.1, "land")
    return with_hsv(px).withColumn("surface", F.coalesce(s, fill))


def by_temperature(px: DataFrame, keys: list[str], method: str = "temperature", land_above: float = 19.0, width: int = 640, height: int = 512, shares: bool = False) -> DataFrame:
    """Adds ``land_mask`` before morphological cleanup. With ``shares``, the variance method compares rounded shares of the
    variance range, which may put a pixel exactly on the limit on either side; else whole numbers, on the land's side."""
    hot = celsius(C("raw")) > land_above
    if method == "temperature":
        return px.withColumn("land_mask", hot)
    if method == "variance" and not shares:
        return px.join(rough_pixels(px, keys, 2, width, height), [*keys, "y", "x"])
    if method in ("variance", "combined"):
        # In raw counts: another unit would only round the shares, which may lie exactly on the limit.
        d = normalised(local_variance(px, keys, 2, width, height, 1), "variance", keys)
        rough = C("variance_norm") >= 0.3 if method == "variance" else (hot | (C("variance_norm") > 0.3))
        return d.withColumn("land_mask", rough)
    if method == "adaptive":
        d = local_variance(raster.sobel(px, "raw", keys), keys, 7, width, height)
        d = normalised(normalised(normalised(d, "raw", keys), "variance", keys, 1e-10), "magnitude", keys, 1e-10)
        score = (1 - C("raw_norm")) * 0.4 + (1 - C("variance_norm")) * 0.3 + (1 - C("magnitude_norm")) * 0.3
        return d.withColumn("score", score).withColumn("land_mask", score <= 0.5)
    raise ValueError(method)


def rough_pixels(px: DataFrame, keys: list[str], r: int, width: int, height: int) -> DataFrame:
    """(keys, y, x, land_mask): pixels from 3/10 of their frame's range of local variances on, all if it has none.

    Nothing is divided: mirrored windows hold equally many pixels, and n * (sum of squares) - (sum)^2 of raw counts is whole.
    """
    v = C("raw") - F.lit(2950.0)
    s = raster.box_sums(px, {"s": v, "ss": v * v}, keys, r, width, height)
    s = s.select(*keys, "y", "x", (C("n") * C("ss") - C("s") * C("s")).alias("variance"))
    w = Window.partitionBy(*keys)
    lo, hi = F.min("variance").over(w), F.max("variance").over(w)
    return s.select(*keys, "y", "x", ((C("variance") - lo) * 10 >= (hi - lo) * 3).alias("land_mask"))


def normalised(d: DataFrame, column: str, keys: list[str], eps: float = 0.0) -> DataFrame:
    from ..functions.infrared import minmax_norm

    return d.withColumn(f"{column}_norm", minmax_norm(C(column), keys, eps))


def local_variance(px: DataFrame, keys: list[str], r: int, width: int, height: int, unit: int = 100) -> DataFrame:
    """Adds the mirrored-border variance of temperature (or of raw counts with ``unit`` 1), carrying every column of the
    pixel through the windows."""
    s = raster.local_stats(px, "raw", keys, r, width, height, "reflect", 2950.0).drop("mean")
    s = s.withColumn("variance", C("variance") / unit)
    return px.join(s, [*keys, "y", "x"])


def _masks(px: DataFrame, flags: dict[str, Column], keys: list[str], width: int, height: int, make) -> DataFrame:
    """(keys, y, x, ocean, land, waves): what ``make`` turns the flags of whole frames into."""
    d = px.select(*keys, "y", "x", *[c.alias(n) for n, c in flags.items()])
    made = ["ocean", "land", "waves"]
    return raster.per_frame(d, keys, list(flags), made, make, (height, width)).select(*keys, "y", "x", *made)


def rule_masks(px: DataFrame, keys: list[str], width: int, height: int, size: int = 100, specks: int = 25, holes: int = 200, fraction: float = 0.05) -> DataFrame:
    """The survey's rules with cleanup: specks dropped, one significant ocean kept, rejected ocean turned into land,
    holes filled. Filled holes keep their other masks, so masks may overlap."""
    seg = by_rules(px)
    flags = {"_o": C("surface") == "ocean", "_w": C("surface") == "waves"}
    return _masks(seg, flags, keys, width, height, lambda o, w: grids.cleaned_rules(o, w, size, specks, holes, fraction))


def _flagged(px: DataFrame, **groups: tuple[Column, ...]) -> dict[str, Column]:
    return {f"_{g}{i}": m for g, masks in groups.items() for i, m in enumerate(masks)}


def hsv_masks(px: DataFrame, keys: list[str], width: int, height: int, size: int = 200, specks: int = 50) -> DataFrame:
    """Each mask cleaned and smoothed, then waves beat land and land beats ocean."""
    return _masks(with_hsv(px), _flagged(px, h=_hsv_masks()), keys, width, height, lambda *m: grids.cleaned_ranges(*m, size, specks))


def lab_masks(px: DataFrame, keys: list[str], width: int, height: int, size: int = 200, specks: int = 50) -> DataFrame:
    return _masks(with_lab(px), _flagged(px, l=_lab_masks()), keys, width, height, lambda *m: grids.cleaned_ranges(*m, size, specks))


def vote_masks(px: DataFrame, keys: list[str], width: int, height: int, **sizes: int) -> DataFrame:
    """Both segmentations and strong colours vote; undefined pixels near only one class join it."""
    r, g, b = C("r"), C("g"), C("b")
    flags = _flagged(px, h=_hsv_masks(), l=_lab_masks(), s=((b > r * 1.2) & (b > g * 1.1) & (b > 50), (g > r * 1.1) & (g > b * 1.1) & (g > 30)))
    return _masks(with_lab(with_hsv(px)), flags, keys, width, height, lambda *m: grids.cleaned_vote(m[:3], m[3:6], m[6], m[7], **sizes))


def temperature_mask(
    px: DataFrame, keys: list[str], method: str = "temperature", land_above: float = 19.0, width: int = 640, height: int = 512,
    size: int = 100, score_size: int = 1000, score_holes: int = 1000,
) -> DataFrame:
    """(keys, y, x, land_mask): any of the temperature methods, closed and without specks; the rest is ocean."""
    d = by_temperature(px, keys, method, land_above, width, height, shares=True).select(*keys, "y", "x", C("land_mask").alias("_l"))

    def make(land):
        land = grids.cleaned_score(~land, score_size, score_holes) if method == "adaptive" else land
        return {"land_mask": grids.cleaned_land(land, size)}

    return raster.per_frame(d, keys, ["_l"], ["land_mask"], make, (height, width)).select(*keys, "y", "x", "land_mask")


def cleaned_ocean(seg: DataFrame, keys: list[str], width: int, height: int, min_size: int, hole: int, fraction: float = 0.05) -> DataFrame:
    """Largest ocean region of each frame after dropping specks and filling small holes."""
    mask = seg.filter(C("surface") == "ocean").select(*keys, "y", "x")
    big = regions.largest_component(regions.remove_small_objects(mask, keys, width, min_size), keys, width, height, fraction)
    return regions.remove_small_holes(big, big.select(*keys).distinct(), keys, width, height, hole)


def auto_label(px: DataFrame) -> DataFrame:
    """Training labels from colour; the order of the rules matters."""
    h = with_hsv(px)
    s, v = C("s") / 255, C("v") / 255
    i = colour.intensity(C("r"), C("g"), C("b"))
    dom = colour.blue_dominance(C("r"), C("g"), C("b"), 1.0)
    blue = (dom > 1.3) & (C("b") > 50)
    return h.withColumn(
        "label",
        F.when((v > 0.8) & (s < 0.3), "wave")
        .when(blue & (i > 180), "wave")
        .when(blue, "ocean")
        .when((s < 0.2) & (i > 50) & (i < 150), "rock")
        .otherwise("land"),
    )


def ocean_features(px: DataFrame, keys: list[str]) -> DataFrame:
    """Warm and cold anomalies beyond 1.5 standard deviations and fronts above the 90th gradient percentile."""
    d = raster.sobel(px, "raw", keys)
    o = d.filter("ocean")
    s = o.groupBy(*keys).agg(
        F.avg("raw").alias("_m"), F.stddev_pop("raw").alias("_s"), F.percentile("magnitude", F.lit(0.9)).alias("_p")
    )
    j = o.join(s, keys)
    return j.select(
        *keys,
        "y",
        "x",
        (C("raw") > C("_m") + C("_s") * 1.5).alias("warm"),
        (C("raw") < C("_m") - C("_s") * 1.5).alias("cold"),
        (C("magnitude") > C("_p")).alias("front"),
    )
