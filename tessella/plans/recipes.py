"""Preprocessing recipes: named chains of operators that record their steps, the corridor pipeline, and a whole data set's run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import join_same
from ..operators import radiometry as R
from ..operators import resample as S
from ..operators import shift, stencil
from ..operators.tables import checked, one_to_one, pair_check

V = F.col
Step = tuple[str, Callable[[DataFrame], DataFrame]]
RECIPES = ("OHRC_NAC", "IIRS_WAC", "DFSAR_SELENE", "TMC_NAC", "IIRS_1P5UM")
#: Fixed value: the wavelength, in micrometres, of the band that registration uses.
TARGET_UM = 1.5


def _value(fn) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("v", fn(V("v")))


U8, CLAHE = ("normalize_u8", R.normalize_u8), ("clahe", stencil.equalize_adaptive)
SHADOW, LOG = ("shadow_lift", _value(R.shadow_lift)), ("log_compress", R.log_compress)


def nadir_band(labels: list[str] | None, bands: int) -> int:
    """The place of the label nadir, in any case; without one, the middle band."""
    low = [x.lower() for x in labels or []]
    return low.index("nadir") if "nadir" in low else bands // 2


def pick_nadir(cube: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """The nadir band of each product of pixels(product, band, y, x, v); rasters without bands pass as they are."""
    if "band" not in cube.columns:
        return cube
    bands = cube.groupBy("product").agg(F.countDistinct("band").alias("bands"))
    wanted = F.floor(V("bands") / 2)
    if labels and "nadir" in [x.lower() for x in labels]:
        wanted = F.lit(nadir_band(labels, len(labels)))
    return join_same(cube, bands, "product").where(V("band") == wanted).drop("band", "bands")


def pick_contrast(cube: DataFrame) -> DataFrame:
    """The band of greatest spread of each product, the first of equals; rasters without bands pass."""
    if "band" not in cube.columns:
        return cube
    spread = cube.groupBy("product", "band").agg(F.stddev_pop("v").alias("spread"))
    best = spread.groupBy("product").agg(F.max_by("band", F.struct(V("spread"), -V("band"))).alias("best"))
    return join_same(cube, best, "product").where("band = best").drop("band", "best")


def pick_wavelength(cube: DataFrame, wavelengths: DataFrame | None, target: float = TARGET_UM) -> DataFrame:
    """The band of each product whose centre (product, band, wavelength_um) is nearest to the target, the first of equals. Bands and
    centres must correspond one to one; without centres the band of greatest spread is taken."""
    if "band" not in cube.columns:
        return cube
    if wavelengths is None:
        return pick_contrast(cube)
    sound = one_to_one(cube.select("product", "band"), wavelengths, "product").select("product")
    best = wavelengths.groupBy("product").agg(F.min_by("band", F.struct(F.abs(V("wavelength_um") - target), "band")).alias("best"))
    return join_same(cube, join_same(best, sound, "product"), "product").where("band = best").drop("band", "best")


def recipe(name: str, source_res: float | None = None, target_res: float | None = None, reference: DataFrame | None = None, labels: list[str] | None = None, wavelengths: DataFrame | None = None) -> list[Step]:
    """Steps of a sensor pair's recipe; an unknown pair raises. ``reference``: a raster whose histogram the spectral recipes match;
    ``labels``: the stereo bands' names; ``wavelengths``: (product, band, wavelength_um) of cubes."""
    band: list[Step] = [("reference_band", pick_contrast)]
    resample: list[Step] = [("resample", lambda df: S.resample(df, source_res, target_res))] if source_res and target_res else []
    match: list[Step] = [("histogram_match", lambda df: R.match_histograms(df, R.normalize_u8(reference)))] if reference is not None else []
    recipes: dict[str, list[Step]] = {
        "OHRC_NAC": [*band, *resample, U8, CLAHE, ("invert", _value(R.invert)), ("dilate", stencil.dilate_cross)],
        "IIRS_WAC": [*band, *resample, U8, *match, SHADOW, LOG],
        "DFSAR_SELENE": [*band, *resample, U8, ("median", stencil.median_blur), LOG],
        "TMC_NAC": [("nadir_band", lambda df: pick_nadir(df, labels)), U8, CLAHE],
        "IIRS_1P5UM": [("wavelength_band", lambda df: pick_wavelength(df, wavelengths)), U8, *match, SHADOW, LOG],
    }
    if name not in recipes:
        raise ValueError(f"unknown sensor pair {name}; known: {', '.join(recipes)}")
    return recipes[name]


def run_recipe(df: DataFrame, name: str, source_res: float | None = None, target_res: float | None = None, **options) -> DataFrame:
    """The raster after the recipe's steps, with their names in steps_applied. Options as of recipe(). A band is picked only
    from rasters that have bands, and only then is a step."""
    steps = recipe(name, source_res, target_res, **options)
    if "band" not in df.columns:
        steps = [s for s in steps if s[0] not in ("reference_band", "nadir_band", "wavelength_band")]
    for _, step in steps:
        df = step(df)
    return df.withColumn("steps_applied", F.array(*[F.lit(n) for n, _ in steps]))


def to_model_input(df: DataFrame, height: int = 480, width: int = 640, channels: int = 1) -> DataFrame:
    """(product, channel, y, x, v): resized by area, in 0..1, repeated for each channel."""
    if channels not in (1, 3):
        raise ValueError("a model takes one channel or three")
    ready = S.area_resize(df, height, width).withColumn("v", V("v") / 255.0)
    return ready.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).select("product", "channel", "y", "x", "v")


def process_dataset(products: list[tuple[str, str]], load: Callable[[str, str], DataFrame], save: Callable[[str, DataFrame], None], options: dict[str, dict] | None = None) -> list[dict]:
    """Each product (name, sensor) loaded, put through its sensor's recipe and saved, one after another, since each is a job of its own;
    a product that fails is reported and does not stop the others. Gives product, sensor, ok, error, steps."""
    by_sensor = {"OHRC": "OHRC_NAC", "TMC": "TMC_NAC", "IIRS": "IIRS_1P5UM"}
    out = []
    for name, sensor in products:
        row = {"product": name, "sensor": sensor, "ok": False, "error": None, "steps": None}
        if sensor not in by_sensor:
            row["error"] = "unrecognised sensor"
        else:
            try:
                given = (options or {}).get(sensor, {})
                pixels = load(name, sensor)
                save(name, run_recipe(pixels, by_sensor[sensor], **given).drop("steps_applied"))
                steps = [n for n, _ in recipe(by_sensor[sensor], **given)]
                row |= {"ok": True, "steps": steps if "band" in pixels.columns else [s for s in steps if not s.endswith("_band")]}
            except Exception as error:  # noqa: BLE001 -- whatever stops a product is its result
                row["error"] = str(error).splitlines()[0][:300]
        out.append(row)
    return out


def corridor(a: DataFrame, b: DataFrame, bins: int, multiple: int = 8) -> DataFrame:
    """Two rasters on a common grid: even bins, stretch of valid pixels, joint validity, padding; one plan from scan to tensor."""
    ready = []
    for df in (a, b):
        binned = S.bin_means(df, bins, half_even=True).withColumn("v", F.col("v").cast("double"))
        ready.append(S.pad_to_multiple(R.normalize_masked(binned).select("product", "y", "x", "v"), multiple).select("y", "x", "v", "valid"))
    return ready[0].withColumnsRenamed({"v": "va", "valid": "valid_a"}).join(ready[1].withColumnsRenamed({"v": "vb", "valid": "valid_b"}), ["y", "x"])


def register_corridor(a: DataFrame, b: DataFrame, window: tuple[int, int, int, int], bins: int, radius: int, least: int, multiple: int = 8) -> dict[str, DataFrame]:
    """The whole way from two strips to a packed pair: the window that both see is cut out (y0, height, x0, width), both go onto a common
    grid, gradients are taken and smoothed, the best shifts found by magnitude and by orientation, the pair checked, and the stretched, padded
    tensors given. Every table is lazy, so only what is asked for is computed."""
    y0, height, x0, width = window
    cut = [S.window_crop(df, y0, height, x0, width).withColumn("y", V("y") - y0).withColumn("x", V("x") - x0) for df in (a, b)]
    grid = [S.bin_means(df, bins, half_even=True).withColumn("v", V("v").cast("double")) for df in cut]
    edges = [stencil.box_mean(stencil.gradient_magnitude(df).withColumn("v", V("v").cast("double"))) for df in grid]
    turned = [stencil.orientation(df).drop("product") for df in grid]
    return {
        "grid_a": grid[0], "grid_b": grid[1],
        "shifts": shift.best(shift.correlate_bands(edges[0], edges[1], radius, least)),
        "orientation_shifts": shift.best(shift.orientation_bands(turned[0], turned[1], radius, least)),
        "check": checked(pair_check(grid[0], grid[1]), (V("unpaired") == 0) & (V("common") > 0), "the pair has unequal shapes or no common valid pixel"),
        "pair": corridor(cut[0], cut[1], bins, multiple),
    }
