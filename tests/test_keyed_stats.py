import math

import numpy as np
import pandas as pd
import pytest

from longspan.operators.stats import collect_stats
from longspan.streaming import keyed_stats as K

SCHEMA = "label long, value double"


@pytest.fixture(scope="module")
def session(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "3")
    K.use_keyed_state(own)
    return own


def arrive(session, folder, rows):
    session.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def run(session, folder, eps=1e-5, broken=False):
    source = session.readStream.schema(SCHEMA).parquet(str(folder / "in"))

    def sink(batch, number):
        batch.count()
        if broken:
            raise RuntimeError("the sink broke")

    query = (K.running_stats(source, eps).writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", str(folder / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination(120)


def kept(session, folder):
    return {r.label: r for r in K.kept_stats(session, str(folder / "ckpt")).collect()}


def test_restarted_from_the_checkpoint_alone_after_a_failed_batch(session, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(rng.normal(1e6, 3, 900))]
    rows += [(0, float(v)) for v in rng.normal(-2, 1, 900)]  # a hot label
    arrive(session, tmp_path, rows[:700] + [(None, 1.0), (1, None), (1, math.nan), (2, math.inf)])
    run(session, tmp_path)
    first = kept(session, tmp_path)
    arrive(session, tmp_path, rows[700:1200])
    with pytest.raises(Exception, match="sink broke"):
        run(session, tmp_path, broken=True)
    run(session, tmp_path)  # the failed batch comes again, once
    arrive(session, tmp_path, rows[1200:] + [(7, 4.0)])
    run(session, tmp_path)
    got = kept(session, tmp_path)
    wanted = {r.label: r for r in collect_stats(session.createDataFrame(rows + [(7, 4.0)], SCHEMA)).collect()}
    assert set(got) == set(wanted) == {0, 1, 2, 7} and set(first) == {0, 1, 2}
    for label, row in wanted.items():
        assert (got[label]["count"], got[label].negative) == (row["count"], row.negative)
        assert (got[label].minval, got[label].maxval) == (row.minval, row.maxval)
        assert (got[label].mean, got[label].variance) == pytest.approx((row.mean, max(row.variance, 1e-5)), rel=1e-9)


def test_variance_is_held_after_every_batch(session, tmp_path):
    for value in (5.0, 5.0):
        arrive(session, tmp_path, [(1, value)] * 2)
        run(session, tmp_path, eps=1.0)
    # The held variance enters the next merge: (2 * 1 + 2 * 0) / 4 = 0.5, held at 1 again.
    arrive(session, tmp_path, [(1, 9.0)] * 4)
    run(session, tmp_path, eps=1.0)
    row = kept(session, tmp_path)[1]
    assert (row["count"], row["mean"]) == (8, 7.0)
    assert row.variance == pytest.approx((4 * (1 + 4) + 4 * 4) / 8)


def test_kept_statistics_scale_other_rows(session, tmp_path):
    arrive(session, tmp_path, [(1, 1.0), (1, 3.0)])
    run(session, tmp_path)
    frozen = K.kept_stats(session, str(tmp_path / "ckpt"))
    batch = session.createDataFrame([(1, 4.0), (1, None), (2, 5.0)], SCHEMA)
    assert [r.value for r in K.standardised(batch, frozen, 0.0).orderBy("label", "value").collect()] == [0.0, 2.0, 0.0]
    assert K.standardised(batch, frozen).where("value IS NOT NULL").count() == 1


def test_batches_of_a_task_shrink_together():
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"label": rng.integers(0, 50, 400), "value": rng.normal(1e6, 2, 400)}) for _ in range(6)]
    whole = pd.concat(frames)
    got = pd.concat(K._partials(iter([*frames, whole[:0]]))).set_index("label")
    assert got.index.is_unique
    wanted = whole.groupby("label")["value"]
    for name, values in {"count": wanted.count(), "mean": wanted.mean(), "variance": wanted.var(ddof=0),
                         "minval": wanted.min(), "maxval": wanted.max()}.items():
        assert got[name].to_dict() == pytest.approx(values.to_dict(), rel=1e-9)
