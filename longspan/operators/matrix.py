"""Assembly and standardisation of dense observation matrices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspan.operators.extract import BACKGROUND_RATE
from longspan.operators.stats import padding_count, pool_partials
from longspan.schema import require
from longspan.session import materialise

# Fixed value: the standard concept of age, first row of every matrix.
AGE_CONCEPT = 3022304
# A label dimension beyond this does not fit an array column.
MAX_LABELS = 100_000
# Dense rows laid out at once.
DENSE_BYTES = 32_000_000
KINDS = ("identity", "standard", "gelman", "gelman_with_fallbacks")


@dataclass(frozen=True)
class ModeParams:
    """How the labels of one data mode are standardised."""

    kind: str
    noshift: bool = False
    log: bool = False
    postfill: bool = False
    fill: float = 0.0
    agg_mode: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown standardisation: {self.kind}")


# The default treatment of each mode.
DEFAULT_PARAMS: Mapping[str, ModeParams] = {
    "Age": ModeParams("gelman"),
    "Sex": ModeParams("identity"),
    "Race": ModeParams("identity"),
    "Condition": ModeParams("gelman_with_fallbacks", noshift=True, log=True, postfill=True,
                            fill=1e-6, agg_mode=True),
    "Medication": ModeParams("gelman", noshift=True, postfill=True, agg_mode=True),
    "Measurement": ModeParams("gelman_with_fallbacks"),
    "Procedure": ModeParams("gelman", noshift=True, postfill=True, agg_mode=True),
}
EPS = 1e-6


def background_params(rate: float = BACKGROUND_RATE) -> Mapping[str, ModeParams]:
    """The defaults with conditions filled at their background rate."""
    condition = DEFAULT_PARAMS["Condition"]
    changed = ModeParams(condition.kind, condition.noshift, condition.log, condition.postfill,
                         rate, condition.agg_mode)
    return {**DEFAULT_PARAMS, "Condition": changed}


def _filled(stats: DataFrame, modes: DataFrame, n_obs: int | None, applies: Column,
            fill: Column) -> DataFrame:
    """Statistics per label after filling to ``n_obs`` and pooling by mode.

    Labels whose mode pools share one group; every other label is its own.
    """
    own = stats.join(modes, "label").withColumns({
        "group": F.when(F.col("agg_mode") & applies, F.concat(F.lit("mode "), "data_mode"))
        .otherwise(F.concat(F.lit("label "), F.col("label").cast("string"))),
        "value": fill,
    })
    padded = own.filter(F.col("postfill") & applies & F.col("value").isNotNull())
    pad = padding_count(F.lit(n_obs))
    value = F.col("value")
    padding = padded.select(
        "group", pad.alias("count"), value.alias("mean"), F.lit(0.0).alias("variance"),
        F.when(value < 0, pad).otherwise(F.lit(0)).cast("long").alias("negative"),
        value.alias("minval"), value.alias("maxval"),
    )
    pooled = pool_partials(own.select(*padding.columns).unionByName(padding), "group")
    return own.select("label", "group").join(pooled, "group").drop("group")


def make_scaler(
    base: DataFrame, lg10: DataFrame, modes: DataFrame, n_obs: int | None = None,
    params: Mapping[str, ModeParams] = DEFAULT_PARAMS,
) -> DataFrame:
    """Shift, scale and log flag per label from plain and log10 statistics.

    ``modes`` is (label, data_mode). All inputs have one row per label. Labels
    without log statistics keep NULL there and fall back as the rules say.
    """
    rows = [(m, p.kind, p.noshift, p.log, p.postfill, float(p.fill), p.agg_mode)
            for m, p in params.items()]
    table = base.sparkSession.createDataFrame(
        rows, "data_mode string, kind string, noshift boolean, log boolean, "
        "postfill boolean, fill double, agg_mode boolean"
    )
    # One row per label from here on.
    modes = materialise(modes.select("label", "data_mode").join(table, "data_mode", "left"))
    modes = require(modes, F.col("kind").isNotNull(), "a data mode has no standardisation")
    if n_obs is None and not modes.filter("postfill").isEmpty():
        raise ValueError("n_obs is required to fill after the fact")
    plain = _filled(materialise(base), modes, n_obs, F.lit(True), F.col("fill"))
    logged = _filled(materialise(lg10), modes, n_obs, F.col("log"),
                     F.when(F.col("fill") > 0, F.log10("fill")))
    logs = logged.select("label", F.col("mean").alias("lmean"), F.col("variance").alias("lvariance"))
    joined = plain.join(modes, "label").join(logs, "label", "left")

    sdev = F.sqrt("variance")
    flat = (F.abs("variance") <= 1e-8 + 1e-5 * F.abs("variance")) | (
        F.col("maxval") - F.col("minval") < 1e-6 * (F.col("maxval") + F.col("minval"))
    )
    negatives = F.col("negative") > 0.01 * F.col("count")
    fallback = F.col("kind") == "gelman_with_fallbacks"
    constant, negative = fallback & flat, fallback & ~flat & negatives
    identity = F.col("kind") == "identity"
    doubled = F.when(F.col("kind") == "standard", 1.0).otherwise(2.0)
    shift = (
        F.when(identity, 0.0)
        .when(constant, F.col("minval"))
        .when(negative, F.col("mean"))
        .when(F.col("noshift"), 0.0)
        .otherwise(F.when(F.col("log"), F.col("lmean")).otherwise(F.col("mean")))
    )
    scale = (
        F.when(identity | constant, 1.0)
        .when(negative, 2 * sdev)
        .otherwise(doubled * F.when(F.col("log"), F.sqrt("lvariance")).otherwise(sdev))
    )
    return joined.select(
        "label",
        shift.cast("double").alias("shift"),
        scale.cast("double").alias("scale"),
        (F.col("log") & ~constant & ~negative).alias("log10"),
        F.lit(EPS).alias("eps"),
    )


def scaled(value: Column) -> Column:
    """(log10(v + eps) or v, minus shift) / scale, from scaler columns."""
    level = F.when(F.col("log10"), F.log10(value + F.col("eps"))).otherwise(value)
    return F.try_divide(level - F.col("shift"), F.col("scale"))


def unscaled(value: Column) -> Column:
    level = value * F.col("scale") + F.col("shift")
    return F.when(F.col("log10"), F.pow(F.lit(10.0), level) - F.col("eps")).otherwise(level)


def _converted(data: DataFrame, scaler: DataFrame, target: str, change: Column, kind: str = "double") -> DataFrame:
    """``change`` of each row beside its scaler as ``target``; a label that has none raises."""
    absent = F.raise_error(F.concat(F.lit("no scaler for label "), F.col("label").cast("string")))
    joined = data.join(scaler.withColumn("__known", F.lit(True)), "label", "left")
    checked = F.when(F.col("__known").isNull(), absent.cast(kind)).otherwise(change)
    return joined.withColumn(target, checked).select(*data.columns, *({target} - set(data.columns)))


def apply_scaler(data: DataFrame, scaler: DataFrame, value: str = "value") -> DataFrame:
    """Scaled values; a label without a scaler raises."""
    return _converted(data, scaler, value, scaled(F.col(value)))


def invert_scaler(data: DataFrame, scaler: DataFrame, value: str = "value") -> DataFrame:
    """Values in their original units; a label without a scaler raises."""
    return _converted(data, scaler, value, unscaled(F.col(value)))


def impact(
    data: DataFrame, scaler: DataFrame, delta: str = "delta", anchor: float = 1.0, digits: int = 2
) -> DataFrame:
    """What a change of ``delta`` means in the original units, as text.

    Additive labels give a signed difference. Log labels give a factor with
    the prefix x (increase) or / (decrease). The number is rounded before it is
    printed: floor(|number| 10^digits + 1/2) / 10^digits with the number's sign, so
    halves go away from zero whatever prints them. A label without a scaler raises.
    """
    def shown(form: str, number: Column) -> Column:
        unit = F.lit(float(10**digits))
        return F.format_string(form, F.signum(number) * (F.floor(F.abs(number) * unit + 0.5) / unit))

    low = unscaled(F.lit(anchor))
    high = unscaled(F.lit(anchor) + F.col(delta))
    factor = F.when(low < high, high / low).otherwise(low / high)
    plain, signed = f"%.{digits}f", f"%+.{digits}f"
    text = F.when(
        F.col("log10"),
        F.concat(F.when(low < high, "x").otherwise("/"), shown(plain, factor)),
    ).otherwise(shown(signed, high - low))
    return _converted(data, scaler, "impact", text, "string")


# --- dense matrices ---------------------------------------------------------


def dense_rows(
    data: DataFrame, keys: list[str], labels: list, fills: Mapping | None = None,
    observations: DataFrame | None = None, required_from: int | None = None,
) -> DataFrame:
    """One row per observation with ``features``, an array in label order.

    Missing labels take their fill (NULL without one). ``observations`` adds
    rows for observations without any value. Only given values are shuffled, as
    compressed rows of slots and values; a batch of those is scattered at once into slices of
    dense rows of at most DENSE_BYTES. A group holds at most one value per label. With
    ``required_from`` an observation without a given value at that place or later raises,
    in the same pass.
    """
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{len(labels)} labels do not fit one array column")
    position = {label: i for i, label in enumerate(labels)}
    spark = data.sparkSession
    kind = data.schema["label"].dataType
    slots = spark.createDataFrame(
        [(label, i) for label, i in position.items()],
        T.StructType([T.StructField("label", kind), T.StructField("slot", T.IntegerType())]),
    )
    placed = data.join(slots, "label").groupBy(*keys, "slot").agg(F.max("value").alias("value"))
    packed = placed.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.collect_list("slot").alias("slots"), F.collect_list("value").alias("values")
    )
    if observations is not None:
        packed = observations.select(*keys).distinct().join(packed, keys, "left")
    packed = packed.select(
        *keys, F.coalesce("slots", F.array().cast("array<int>")).alias("slots"),
        F.coalesce(F.col("values").cast("array<double>"), F.array().cast("array<double>")).alias("values"))
    filler = np.array([np.nan if fills is None else fills.get(x, np.nan) for x in labels], dtype=float)
    step = max(1, DENSE_BYTES // (8 * max(1, len(labels))))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                at, given = part.column("slots"), part.column("values")
                row = np.repeat(np.arange(len(part)), at.value_lengths().to_numpy())
                slot = at.flatten().to_numpy()
                if required_from is not None and len(np.unique(row[slot >= required_from])) < len(part):
                    raise ValueError("an observation has no value of its own: it lies outside the grid")
                dense = np.tile(filler, (len(part), 1))
                dense[row, slot] = given.flatten().to_numpy()
                # NaN marks a slot without value or fill; hand it back as NULL.
                flat = pa.array(dense.ravel(), pa.float64(), from_pandas=True)
                offsets = np.arange(len(part) + 1, dtype=np.int32) * len(labels)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in keys], pa.ListArray.from_arrays(offsets, flat)], [*keys, "features"])

    schema = T.StructType([*[packed.schema[k] for k in keys], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return packed.mapInArrow(scatter, schema)


def dense_long(dense: DataFrame, keys: list[str], labels: list) -> DataFrame:
    """Dense rows as (keys, label, value)."""
    names = F.array(*[F.lit(x) for x in labels])
    return dense.select(*keys, F.posexplode("features").alias("slot", "value")).select(
        *keys, names[F.col("slot")].alias("label"), "value"
    )


def assemble_matrix(
    index: DataFrame, samples: DataFrame, meta: DataFrame, scaler: DataFrame | None,
    cohort: DataFrame, demographic_concepts: list[int], age_mean: float = 0.0, age_sdev: float = 1.0,
    off_grid: str = "raise",
) -> tuple[DataFrame, list[int]]:
    """Feature rows of a sample index, and the feature order.

    Order: age, demographic concepts, then the labels of ``meta`` ascending.
    ``samples`` is (person_id, day, concept_id, value); ``meta`` has concept_id
    and fill_value. Values are scaled sparsely and the fills once per label. A
    point without any sampled value lies off the grid of its person and raises;
    with ``off_grid="fill"`` its row holds fills.
    """
    if off_grid not in ("raise", "fill"):
        raise ValueError("off_grid is raise or fill")
    from longspan.operators.curves import age_samples, demographic_samples

    points = index.select("person_id", F.col("datetime").cast("date").alias("datetime")).distinct()
    fills = meta.select(F.col("concept_id").alias("label"), F.col("fill_value").alias("value"))
    values = samples.select(
        "person_id", F.col("day").alias("datetime"), F.col("concept_id").alias("label"), "value"
    ).join(fills.select("label"), "label", "left_semi")
    values = values.join(points, ["person_id", "datetime"], "left_semi")
    if scaler is not None:
        values, fills = apply_scaler(values, scaler), apply_scaler(fills, scaler)
    # One number per label; the label dimension is checked against MAX_LABELS.
    fill_map = {r["label"]: r["value"] for r in fills.limit(MAX_LABELS + 1).collect()}
    labels = sorted(fill_map)
    gaps = [k for k, v in fill_map.items() if v is None]
    if gaps:
        raise ValueError(f"labels without a usable fill: {gaps[:5]}")
    age = age_samples(points, cohort, age_mean, age_sdev).withColumn("label", F.lit(AGE_CONCEPT).cast("long"))
    demo = demographic_samples(points, cohort, demographic_concepts).withColumnRenamed("concept_id", "label")
    columns = ["person_id", "datetime", "label", "value"]
    merged = values.select(*columns).unionByName(age.select(*columns)).unionByName(
        demo.filter(F.col("value") > 0).select(*columns)
    )
    order = [AGE_CONCEPT, *demographic_concepts, *labels]
    fill_map.update({c: 0.0 for c in demographic_concepts})
    own = 1 + len(demographic_concepts) if off_grid == "raise" else None
    return dense_rows(merged, ["person_id", "datetime"], order, fill_map, points, own), order


def require_complete(dense: DataFrame) -> DataFrame:
    """Every feature of every row must hold a number."""
    full = ~F.exists("features", lambda v: v.isNull() | F.isnan(v))
    return require(dense, full, "the matrix has gaps")
