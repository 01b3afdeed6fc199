"""Training reads its table twice, whatever its splits need."""

import pyarrow as pa
from pyspark.sql import functions as F

from riskframe.contracts import FeatureContract, TrainingConfig
from riskframe.operators import split
from riskframe.plans.train import divided, train


def _watched(spark):
    """A table of 900 rows that counts how many of them are read."""
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(900).select("id", (F.rand(3) * 9).alias("a"), (F.rand(4) - 0.5).alias("b"), (F.col("id") % 4 == 0).cast("int").alias("y")).localCheckpoint()

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema)

    return df, df.mapInArrow(count, df.schema), seen


def test_training_reads_its_table_twice(spark):
    _, df, seen = _watched(spark)
    train(df, "y", ("id",), TrainingConfig(calibration_method="none"))
    assert seen.value == 2 * 900


def test_parts_by_written_positions_are_those_of_the_order(spark):
    df, watched, seen = _watched(spark)
    contract = FeatureContract(("a", "b"), "y", ("id",))
    for config in (TrainingConfig(), TrainingConfig(split_strategy="temporal", time_column="id")):
        before = seen.value
        parts, folds = divided(watched, contract, config)
        assert seen.value - before == 900
        wanted = split.split(df, contract, config)
        assert {r.id: r.split for r in parts.collect()} == {r.id: r.split for r in wanted.collect()}
        again = split.assign_folds(wanted.where("split = 'train'"), contract, 3, split.row_order(contract, config))
        assert {r.id: r.fold for r in folds.collect()} == {r.id: r.fold for r in again.collect()}
        assert parts.columns == ["id", "a", "b", "y", "split"] and folds.columns == ["id", "a", "b", "y", "fold"]
