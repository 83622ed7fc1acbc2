"""Fixed table schemas and the coercion applied at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspan.functions.time import whole_second


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


EHR = _schema(
    ("person_id", T.LongType()),
    ("concept_id", T.LongType()),
    ("datetime", T.TimestampNTZType()),
    ("value", T.DoubleType()),
)
VISITS = _schema(
    ("person_id", T.LongType()),
    ("start_datetime", T.TimestampNTZType()),
    ("end_datetime", T.TimestampNTZType()),
)
SAMPLE_INDEX = _schema(("person_id", T.LongType()), ("datetime", T.TimestampNTZType()))
SAMPLE_SPACE = _schema(
    ("person_id", T.LongType()),
    ("start", T.TimestampNTZType()),
    ("stop", T.TimestampNTZType()),
    ("datapoints", T.LongType()),
)
CONCEPT_META = _schema(
    ("concept_id", T.LongType()),
    ("concept_name", T.StringType()),
    ("domain_id", T.StringType()),
    ("vocabulary_id", T.StringType()),
    ("concept_class_id", T.StringType()),
    ("concept_code", T.StringType()),
    ("data_mode", T.StringType()),
    ("fill_value", T.DoubleType()),
)
PERSON_META = _schema(
    ("person_id", T.LongType()),
    ("birth_date", T.DateType()),
    ("gender_concept_id", T.LongType()),
    ("gender_concept_name", T.StringType()),
    ("gender_source_concept_id", T.LongType()),
    ("gender_source_value", T.StringType()),
    ("race_concept_id", T.LongType()),
    ("race_concept_name", T.StringType()),
    ("race_source_concept_id", T.LongType()),
    ("race_source_value", T.StringType()),
)
STATS = _schema(
    ("label", T.LongType()),
    ("count", T.LongType()),
    ("mean", T.DoubleType()),
    ("variance", T.DoubleType()),
    ("negative", T.LongType()),
    ("minval", T.DoubleType()),
    ("maxval", T.DoubleType()),
)
SCALER = _schema(
    ("label", T.LongType()),
    ("shift", T.DoubleType()),
    ("scale", T.DoubleType()),
    ("log10", T.BooleanType()),
    ("eps", T.DoubleType()),
)

# Older tables name these columns differently.
SYNONYMS = {
    "birthdate": "birth_date",
    "measurement_concept_id": "concept_id",
    "date": "datetime",
}


def finite(value: Column) -> Column:
    """NaN and infinities mean "no value": turn them into NULL."""
    unusable = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~unusable, value)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select, order and cast to ``schema``; fail on a missing column.

    Doubles lose NaN in favour of NULL and timestamps are cut to whole seconds,
    the resolution of the event tables.
    """
    for old, new in SYNONYMS.items():
        if old in df.columns and new not in df.columns and new in schema.names:
            df = df.withColumnRenamed(old, new)
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from table: {missing}")
    columns = []
    for field in schema.fields:
        column = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            column = finite(column)
        elif isinstance(field.dataType, T.TimestampNTZType):
            column = whole_second(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Return ``df`` if no row breaks ``condition`` (NULL counts as a breach)."""
    if not df.filter(~F.coalesce(condition, F.lit(False))).isEmpty():
        raise ValueError(message)
    return df


def require_visits(visits: DataFrame) -> DataFrame:
    """Visits must carry a person and both ends."""
    present = (
        F.col("person_id").isNotNull()
        & F.col("start_datetime").isNotNull()
        & F.col("end_datetime").isNotNull()
    )
    return require(visits, present, "visits hold NULL in a key or a date")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number differs, with ``surplus``: how many more ``left`` holds. NULL equals NULL.

    Both sides are counted before they meet, so repeated rows cost one row each.
    """
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    def signed(df, sign):
        return df.groupBy(*df.columns).agg(F.sum(F.lit(sign)).alias("__n"))
    both = signed(left, 1).unionByName(signed(right, -1))
    uneven = both.groupBy(*left.columns).agg(F.sum("__n").alias("surplus"))
    return uneven.filter(F.col("surplus") != 0)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Table equality with duplicates; NULL equals NULL."""
    return left.columns == right.columns and differing_rows(left, right).isEmpty()
