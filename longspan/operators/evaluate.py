"""Evaluation of predictions and of data selections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.schema import require
from longspan.operators.running import bucket_count, hash_bucket, range_bucket, running_total
from longspan.session import materialise

THRESHOLDS = (1, 10, 100, 500, 1000, 2000)


def threshold_grid(counts: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Concepts with at least so many persons and mentions, per pair of limits.

    Concepts fall into a two-dimensional histogram over the limits they reach; sums from
    the greatest limits down, in one direction and then in the other, answer all cells.
    """
    limits = sorted(set(thresholds))
    steps = F.array(*[F.lit(t).cast("long") for t in limits])

    def reached(column: str) -> Column:
        return F.size(F.filter(steps, lambda t: t <= F.col(column)))

    filled = counts.groupBy(reached("persons").alias("p"), reached("mentions").alias("m")).agg(
        F.count(F.lit(1)).alias("n")).where("p > 0 and m > 0")
    size = len(limits)
    cells = counts.sparkSession.range(size * size).select(
        (F.floor(F.col("id") / size) + 1).cast("int").alias("p"), (F.col("id") % size + 1).cast("int").alias("m"))

    def downward(fixed: str, along: str) -> Column:
        return F.sum("n").over(Window.partitionBy(fixed).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0))

    whole = cells.join(filled, ["p", "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    summed = whole.withColumn("n", downward("p", "m")).withColumn("n", downward("m", "p"))
    return summed.select(
        F.element_at(steps, F.col("p")).alias("persons"), F.element_at(steps, F.col("m")).alias("mentions"),
        F.col("n").alias("concepts"))


def shared_histogram(data: DataFrame, group: str, value: str, edges: int) -> DataFrame:
    """Counts per group on common even bins between the overall extremes.

    ``edges`` edges make ``edges - 1`` bins; the last one is closed.
    """
    if edges < 2:
        raise ValueError("a histogram needs two edges")
    ends = data.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    low, width = float(ends["lo"]), (float(ends["hi"]) - float(ends["lo"])) / (edges - 1)
    place = F.lit(0) if width == 0 else F.floor((F.col(value) - low) / width)
    slot = F.least(place.cast("long"), F.lit(edges - 2).cast("long"))
    return data.filter(F.col(value).isNotNull()).groupBy(group, slot.alias("bin")).agg(
        F.count("*").alias("n")
    )


def signed_histogram(data: DataFrame, value: str, edges: int = 101) -> DataFrame:
    """Histogram of positive and negative values on common bins; zeros are left out."""
    side = F.when(F.col(value) > 0, "pos").when(F.col(value) < 0, "neg")
    signed = data.select(side.alias("side"), F.col(value)).filter(F.col("side").isNotNull())
    return shared_histogram(signed, "side", value, edges)


def epoch_losses(losses: DataFrame, a_min: float | None = None, a_max: float | None = None,
                 agg=F.avg) -> DataFrame:
    """Aggregate per (split, epoch), clipped, with a mark where clipping acted."""
    raw = losses.groupBy("split", "epoch").agg(agg("loss").alias("raw"))
    held = F.col("raw")
    if a_min is not None:
        held = F.greatest(held, F.lit(a_min))
    if a_max is not None:
        held = F.least(held, F.lit(a_max))
    return raw.select("split", "epoch", held.alias("loss"), (held != F.col("raw")).alias("clipped"))


def best_epoch(per_epoch: DataFrame) -> DataFrame:
    """Epoch with the least loss per split; the earliest wins a tie."""
    best = F.min(F.struct("loss", "epoch"))
    return per_epoch.groupBy("split").agg(best.alias("b")).select("split", "b.epoch", "b.loss")


def gaussian_nll(mean: Column, target: Column, variance: Column, alpha: float = 1.0,
                 beta: float = 1.0, full: bool = False, eps: float = 1e-6) -> Column:
    """0.5 (alpha ln var + beta (mean - target)^2 / var), var at least eps.

    A negative variance raises when the row is evaluated.
    """
    held = F.greatest(variance, F.lit(eps))
    error = mean - target
    loss = 0.5 * (alpha * F.log(held) + beta * error * error / held)
    if full:
        loss = loss + 0.9189385332046727  # ln(2 pi) / 2
    broken = F.raise_error(F.lit("negative variance")).cast("double")
    return F.when(variance < 0, broken).otherwise(loss)


def nll_loss(data: DataFrame, reduction: str = "mean", **options) -> DataFrame:
    loss = gaussian_nll(F.col("mean"), F.col("target"), F.col("variance"), **options)
    if reduction == "mean":
        return data.agg(F.avg(loss).alias("loss"))
    if reduction == "sum":
        return data.agg(F.sum(loss).alias("loss"))
    return data.withColumn("loss", loss)


def error_intervals(data: DataFrame, scale: float = 1.96, clip: float | None = None) -> DataFrame:
    """Error, half-width of the interval, and distance beyond its nearest edge."""
    error = F.col("mean") - F.col("target")
    half = F.lit(scale) * F.sqrt("variance")
    out = data.withColumns({"error": error, "interval": half})
    out = out.withColumn("outside", F.abs("error") > F.col("interval"))
    edge = F.when(F.col("error") > 0, F.col("mean") - F.col("interval")).otherwise(
        F.col("mean") + F.col("interval")
    )
    out = out.withColumn("beyond", F.when(F.col("outside"), F.abs(edge - F.col("target"))).otherwise(0.0))
    if clip is not None:
        out = out.withColumns({
            "interval_in_range": F.col("interval") < clip,
            "error_in_range": F.abs("error") < clip,
        }).withColumns({
            "interval": F.least("interval", F.lit(clip)),
            "error": F.greatest(F.lit(-clip), F.least("error", F.lit(clip))),
        })
    return out


def sampled_by_value(data: DataFrame, key: str, value: str, nmax: int = 10_000, seed: int = 0,
                     mask: Column | None = None) -> DataFrame:
    """At most ``nmax`` random rows, ordered by a value; rows picked by a seeded hash."""
    kept = data if mask is None else data.filter(mask)
    order = [F.xxhash64(F.lit(seed), key), F.col(key)]
    return kept.orderBy(*order).limit(nmax).orderBy(value, key)


def leading_elements(components: DataFrame, cutoff: float = 0.95, min_elem: int = 10,
                     max_elem: int = 30, normalise: bool = False) -> DataFrame:
    """Largest elements of each component until they carry its length.

    Input (component, element, value). Elements are ranked by magnitude;
    ``cutoff`` is the share of the length to exceed, held between the limits.
    A component has one row per feature.
    """
    square = F.col("value") * F.col("value")
    by_size = Window.partitionBy("component").orderBy(F.desc(square), "element")
    ranked = components.withColumns({
        "rank": F.row_number().over(by_size),
        "part": F.sum(square).over(by_size.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum(square).over(Window.partitionBy("component")),
    }).withColumn("cumulative", F.sqrt(F.col("part") / F.col("total")))
    reached = F.min(F.when(F.col("cumulative") > cutoff, F.col("rank"))).over(
        Window.partitionBy("component")
    )
    shown = F.least(F.lit(max_elem), F.greatest(F.lit(min_elem), F.col("cutoff")))
    value = F.col("value")
    if normalise:
        value = F.signum("value") * F.sqrt(square / F.col("total"))
    return (
        ranked.withColumn("cutoff", reached)
        .filter(F.col("rank") <= shown)
        .select("component", "element", "rank", value.alias("value"), "cumulative", "cutoff")
    )


# Scores whose draws are held at once, one number per resample each.
SCORES_AT_ONCE = 16_384


# --- ranking quality --------------------------------------------------------


def auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve of (label 0/1, score), ties counted half.

    Rows shrink to one per score; the negatives below each score come from a
    running total over the partitions of a range shuffle, so no task sees all
    scores and scores may be of any type with an order. With ``by`` one value per
    key; all keys share the partitions.
    """
    weight = F.col("weight") if "weight" in scored.columns else F.lit(1)
    groups = scored.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("label") == 1, weight).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(weight)).cast("double").alias("neg"),
    )
    ranked = running_total(range_bucket(groups, ["score"]), "bucket", ["score"], {"below": "neg"}, by)
    wins = F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
    pairs = F.sum("pos") * F.sum("neg")
    if not by:
        return ranked.agg(F.try_divide(wins, pairs).alias("auc"))
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def numbered(df: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """Add ``position`` 0 .. n-1 in a fixed order of the unique ``key``."""
    n = df.count()
    bucketed = df.withColumns({"__bucket": hash_bucket(bucket_count(n), *key), "__one": F.lit(1)})
    placed = running_total(bucketed, "__bucket", list(key), {"position": "__one"})
    return placed.drop("__bucket", "__one"), n


def drawn_positions(spark, n: int, size: int, seed: int, replicates: list[int]) -> DataFrame:
    """``size`` positions per replicate, with replacement, from a seeded hash."""
    pick = F.pmod(F.xxhash64("replicate", "draw", F.lit(seed)), F.lit(n)).alias("position")
    return (
        spark.range(size * len(replicates))
        .select(F.array(*[F.lit(r) for r in replicates])[(F.col("id") / size).cast("int")].alias("replicate"),
                (F.col("id") % size).alias("draw"))
        .groupBy("replicate", pick).agg(F.count("*").alias("weight"))
    )


def _replicated(pos: np.ndarray, neg: np.ndarray, bucket: int) -> pa.Table:
    """Per replicate: pairs won inside a bucket, and its weights; rows are scores in order, columns replicates."""
    below = np.cumsum(neg, axis=0) - neg
    wins = (pos * (below + 0.5 * neg)).sum(0)
    return pa.table({
        "replicate": np.arange(pos.shape[1]), "bucket": np.full(pos.shape[1], bucket),
        "wins": wins, "pos": pos.sum(0).astype(float), "neg": neg.sum(0).astype(float)})


_REPLICATED = "replicate long, bucket long, wins double, pos double, neg double"


def _auc_of_buckets(parts: DataFrame) -> DataFrame:
    """One AUC per replicate from one row per replicate and bucket of scores."""
    earlier = Window.partitionBy("replicate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    return parts.withColumn("won", F.col("wins") + F.col("pos") * before).groupBy("replicate").agg(
        F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def auc_replicates(scored: DataFrame, weights: str, n: int) -> DataFrame:
    """AUC of ``n`` weightings of the same rows, in one pass over their scores.

    ``weights`` is an array column of ``n`` numbers per row. Rows shrink to one vector of
    weights per score and label; prefix sums over the vectors inside the partitions of a range
    shuffle, and then over one row per partition, serve all weightings at once.
    """
    def total(label: int):
        return F.array(*[
            F.sum(F.when(F.col("label") == label, F.col(weights)[i]).otherwise(0)).cast("double") for i in range(n)])

    def bucket(group: pa.Table) -> pa.Table:
        group = group.sort_by("score")
        pos, neg = (np.array(group.column(c).to_pylist(), float).reshape(-1, n) for c in ("pos", "neg"))
        return _replicated(pos, neg, group.column("bucket")[0].as_py())

    groups = scored.groupBy("score").agg(total(1).alias("pos"), total(0).alias("neg"))
    return _auc_of_buckets(range_bucket(groups, ["score"]).groupBy("bucket").applyInArrow(bucket, _REPLICATED))


def auc_bootstrap(scored: DataFrame, key: str | None = None, n: int = 100, seed: int = 0,
                  max_attempts: int = 1000) -> DataFrame:
    """AUC of ``n`` resamples with replacement, each as large as the data and with a positive row.

    Draws fall on scores, as often as those have rows: first on a label (never on no
    positive at all), then on the partitions of a range shuffle, then on the scores in each,
    all multinomial, which is what drawing rows comes to. The rows are read once for
    all resamples; only counts per partition come to the driver. Rows need no ``key``.
    Without any positive row, or if ``max_attempts`` draws find none, this raises.
    """
    groups = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    placed = range_bucket(groups, ["score"])
    sums = placed.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).orderBy("bucket").collect()
    size = {c: np.array([r[c] for r in sums], np.int64) for c in ("pos", "neg")}
    positive, total = int(size["pos"].sum()), int(size["pos"].sum() + size["neg"].sum())
    if not positive:
        raise RuntimeError("no positive row")
    random = np.random.default_rng(seed)
    drawn = random.binomial(total, positive / total, n)
    for _ in range(max_attempts):
        if drawn.all():
            break
        drawn[drawn == 0] = random.binomial(total, positive / total, int((drawn == 0).sum()))
    else:
        raise RuntimeError(f"no positive row within {max_attempts} attempts")
    shares = {"pos": random.multinomial(drawn, size["pos"] / positive)}
    shares["neg"] = (random.multinomial(total - drawn, size["neg"] / (total - positive)) if total > positive
                     else np.zeros_like(shares["pos"]))
    wanted = scored.sparkSession.createDataFrame(
        [(r["bucket"], *[shares[c][:, i].tolist() for c in ("pos", "neg")]) for i, r in enumerate(sums)],
        "bucket long, pos array<long>, neg array<long>")

    def bucket(group: pa.Table, draws: pa.Table) -> pa.Table:
        group, number = group.sort_by("score"), group.column("bucket")[0].as_py()
        inside = np.random.default_rng([seed, 1, number])
        counts = {c: group.column(c).to_numpy() for c in ("pos", "neg")}
        left = {c: np.array(draws.column(c)[0].as_py(), np.int64) for c in counts}
        rest = {c: int(counts[c].sum()) for c in counts}
        found, below = [], np.zeros(n)
        for low in range(0, len(group), SCORES_AT_ONCE):
            taken = {}
            for c in counts:
                part = counts[c][low:low + SCORES_AT_ONCE]
                mass = int(part.sum())
                here = inside.binomial(left[c], mass / rest[c]) if mass else np.zeros(n, np.int64)
                taken[c] = (inside.multinomial(here, part / mass).T if mass
                            else np.zeros((len(part), n), np.int64)).astype(float)
                left[c], rest[c] = left[c] - here, rest[c] - mass
            part = _replicated(taken["pos"], taken["neg"], number)
            wins = part.column("wins").to_numpy() + part.column("pos").to_numpy() * below
            below = below + part.column("neg").to_numpy()
            found.append(part.set_column(2, "wins", pa.array(wins)))
        joined = pa.concat_tables(found)
        return joined.group_by(["replicate", "bucket"]).aggregate([(c, "sum") for c in ("wins", "pos", "neg")]).rename_columns(
            ["replicate", "bucket", "wins", "pos", "neg"])

    return _auc_of_buckets(placed.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(bucket, _REPLICATED))


def cross_validated_forest(data: DataFrame, key: str, features: str = "features",
                           label: str = "label", folds: int = 6, seed: int = 42,
                           trees: int = 100, **params):
    """Balanced random forest per fold; returns models, fold AUCs, predictions.

    Folds split each class evenly by a seeded hash order. Predictions are out of
    fold: each row is scored by the model that did not see it. Labels other
    than 0 and 1 raise.
    """
    require(data, F.col(label).cast("double").isin(0.0, 1.0), "labels must be 0 or 1")
    prepared = data.select(key, array_to_vector(F.col(features)).alias("features"),
                           F.col(label).cast("double").alias("label"))
    placed = []
    for value in (0.0, 1.0):
        part, _ = numbered(prepared.filter(F.col("label") == value), key)
        placed.append(part)
    folded = placed[0].unionByName(placed[1]).withColumn("fold", F.col("position") % folds)
    folded = materialise(folded)  # every fold and tree level reads it
    models, scores, predictions = [], [], []
    for fold in range(folds):
        train = folded.filter(F.col("fold") != fold)
        sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        total = sum(sizes.values())
        weight = F.lit(0.0)
        for value, size in sizes.items():
            weight = F.when(F.col("label") == value, total / (len(sizes) * size)).otherwise(weight)
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                        numTrees=trees, seed=seed, **params)
        model = forest.fit(train.withColumn("weight", weight))
        # A copy leaves the training summary behind: it holds the session, which tasks cannot be sent once rows are observed.
        scored = model.copy().transform(folded.filter(F.col("fold") == fold)).select(
            key, "label", "fold", vector_to_array("probability")[1].alias("score")
        )
        models.append(model)
        predictions.append(scored)
    merged = predictions[0]
    for part in predictions[1:]:
        merged = merged.unionByName(part)
    scores = auc(merged.select("fold", "label", "score"), ("fold",))
    return models, scores, merged
