"""Classification of raw trips: valid trips, rejected rows with one reason each, and the report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.schemas import conform

# Identity of a raw row, and the rejection reasons in order of priority.
KEY_COLUMNS = [
    "bici",
    "ciclo_estacion_retiro",
    "fecha_retiro",
    "hora_retiro",
    "ciclo_estacion_arribo",
    "fecha_arribo",
    "hora_arribo",
]
DUPLICATE = "duplicado"
REASONS = [
    DUPLICATE,
    "fecha_hora_invalida",
    "estacion_origen_ausente",
    "estacion_destino_ausente",
    "arribo_no_posterior",
    "duracion_muy_corta",
    "duracion_muy_larga",
    "bici_ausente",
]


@dataclass(frozen=True)
class CleaningRules:
    date_formats: Sequence[str] = S.DATE_FORMATS
    time_formats: Sequence[str] = S.TIME_FORMATS
    min_duration_minutes: float = 1.0
    max_duration_minutes: float = 240.0


def typed_trip_columns(rules: CleaningRules) -> dict[str, Column]:
    return {
        "trip_id": S.row_hash([F.col(c) for c in KEY_COLUMNS], F.col("source_file")),
        "bike_id": S.clean_id(F.col("bici")),
        "origin_station_id": S.clean_id(F.col("ciclo_estacion_retiro")),
        "dest_station_id": S.clean_id(F.col("ciclo_estacion_arribo")),
        "retiro_ts": S.parse_datetime(F.col("fecha_retiro"), F.col("hora_retiro"), rules.date_formats, rules.time_formats),
        "arribo_ts": S.parse_datetime(F.col("fecha_arribo"), F.col("hora_arribo"), rules.date_formats, rules.time_formats),
    }


def reject_reason(rules: CleaningRules) -> Column:
    """First rule a row breaks, NULL for a valid row; duplicates are told apart elsewhere."""
    start, end, minutes = F.col("retiro_ts"), F.col("arribo_ts"), F.col("duration_min")
    broken = [
        start.isNull() | end.isNull(),
        F.col("origin_station_id").isNull(),
        F.col("dest_station_id").isNull(),
        end <= start,
        minutes < F.lit(float(rules.min_duration_minutes)),
        minutes > F.lit(float(rules.max_duration_minutes)),
        F.col("bike_id").isNull(),
    ]
    return F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in zip(broken, REASONS[1:], strict=True)])


def _typed(rows: DataFrame, rules: CleaningRules) -> DataFrame:
    typed = rows.withColumns(typed_trip_columns(rules))
    timed = typed.withColumn("duration_min", S.duration_min(F.col("retiro_ts"), F.col("arribo_ts")))
    # The reason is unfolded from a one-element array: filters on it stay above. Pushed below, they would
    # carry the whole parsing with them, once per rule, and every row would be parsed many times.
    return timed.select("*", F.explode(F.array(reject_reason(rules))).alias("reason"))


def distinct_rows(raw: DataFrame) -> DataFrame:
    """One row per (file, key columns): the first of its copies in file order, and their number.

    Copies are combined before the shuffle, so a row repeated millions of times costs one record per task.
    The grouping sorts, and a leading number makes that a radix sort: texts are compared only on ties.
    """
    return (
        raw.groupBy(F.xxhash64("source_file", *KEY_COLUMNS).alias("_key"), "source_file", *KEY_COLUMNS)
        .agg(
            F.min_by(F.struct("genero_usuario", "edad_usuario", "row_pos"), "row_pos").alias("_first"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select("source_file", *KEY_COLUMNS, "_first.*", "copies")
    )


def classify_distinct(raw: DataFrame, rules: CleaningRules | None = None) -> DataFrame:
    """Distinct raw rows, typed, with the reason of the first copy and ``copies``."""
    return _typed(distinct_rows(raw), rules or CleaningRules())


def duplicate_flags(raw: DataFrame) -> DataFrame:
    """Every raw row with ``is_duplicate``: whether an earlier row of its file has equal key columns.

    ``(source_file, row_pos)`` is unique, so the join that brings the first positions back has no hot key.
    """
    firsts = distinct_rows(raw).select("source_file", "row_pos", F.lit(True).alias("_is_first"))
    return raw.join(firsts, ["source_file", "row_pos"], "left").withColumn(
        "is_duplicate", F.col("_is_first").isNull()
    ).drop("_is_first")


def classify(raw: DataFrame, rules: CleaningRules | None = None) -> DataFrame:
    """Every raw row, typed, with its reason (NULL for valid rows)."""
    typed = _typed(duplicate_flags(raw), rules or CleaningRules())
    return typed.withColumn("reason", F.when(F.col("is_duplicate"), F.lit(DUPLICATE)).otherwise(F.col("reason")))


def trips_clean(raw: DataFrame, run_id: str, rules: CleaningRules | None = None) -> DataFrame:
    """Valid trips. One shuffle: the grouping that drops copies also makes ``trip_id`` unique."""
    return clean_of(classify_distinct(raw, rules), run_id)


def clean_of(distinct: DataFrame, run_id: str) -> DataFrame:
    """Valid trips of classified distinct rows."""
    valid = distinct.filter(F.col("reason").isNull())
    return conform(
        valid.withColumns(
            {"genero": F.col("genero_usuario"), "edad": S.coerce_age(F.col("edad_usuario")), "run_id": F.lit(run_id)}
        ),
        "trips_clean",
    )


# copies written out by one task at a time; the rest of a much repeated row goes to other tasks
_COPIES_PER_TASK = 100_000


def _rejected_copies(distinct: DataFrame) -> DataFrame:
    """One row per rejected raw row: the first copy under its own reason, all later ones as duplicates.

    Slice 0 stands for the first copy, every further slice for a bounded number of later ones. The slices
    are spread before they are unfolded, so a row with very many copies is written out by many tasks.
    """
    size = F.lit(_COPIES_PER_TASK)
    later = F.col("copies") - 1
    found = distinct.filter(F.col("reason").isNotNull() | (F.col("copies") > 1))
    slices = F.sequence(F.when(F.col("reason").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), F.ceil(later / size))
    spread = found.withColumn("_slice", F.explode(slices)).repartition("source_file", *KEY_COLUMNS, "_slice")
    is_first = F.col("_slice") == 0
    rows = F.when(is_first, F.lit(1)).otherwise(F.least(size, later - (F.col("_slice") - 1) * size)).cast("bigint")
    return spread.withColumns(
        {
            "_copy": F.explode(F.sequence(F.lit(1).cast("bigint"), rows)),
            "reason": F.when(is_first, F.col("reason")).otherwise(F.lit(DUPLICATE)),
        }
    )


def trip_rejections(
    raw: DataFrame, run_id: str, rules: CleaningRules | None = None, rejected_at: Column | None = None
) -> DataFrame:
    """Rejected rows, one per raw row, with the raw date and time texts."""
    return rejections_of(classify_distinct(raw, rules), run_id, rejected_at)


def rejections_of(distinct: DataFrame, run_id: str, rejected_at: Column | None = None) -> DataFrame:
    """Rejected rows of classified distinct rows.

    All that is kept of a copy follows from its key columns, so copies are unfolded from their number:
    the raw rows are read and shuffled once, and no row has to be found again.
    """
    rejected = _rejected_copies(distinct)
    return conform(
        rejected.withColumns(
            {
                "row_hash": F.col("trip_id"),
                "run_id": F.lit(run_id),
                "retiro_raw": F.concat("fecha_retiro", F.lit(" "), "hora_retiro"),
                "arribo_raw": F.concat("fecha_arribo", F.lit(" "), "hora_arribo"),
                "rejected_at_utc": F.localtimestamp() if rejected_at is None else rejected_at,
            }
        ),
        "trip_rejections",
    )


def rejection_report(raw: DataFrame, rules: CleaningRules | None = None) -> DataFrame:
    """One row per file: total, valid, rejected, percentage, and a count per reason."""
    return report_of(classify_distinct(raw, rules))


def report_of(distinct: DataFrame) -> DataFrame:
    """The report of classified distinct rows."""

    def rows_with(reason: str) -> Column:
        if reason == DUPLICATE:
            return F.sum(F.col("copies") - 1)
        return F.count_if(F.col("reason") == reason)

    totals = distinct.groupBy("source_file").agg(
        F.sum("copies").alias("total"),
        F.count_if(F.col("reason").isNull()).alias("validas"),
        *[rows_with(r).alias(f"motivo_{r}") for r in REASONS],
    )
    rejected = F.col("total") - F.col("validas")
    return totals.select(
        "source_file",
        "total",
        "validas",
        rejected.alias("rechazadas"),
        S.pct(rejected, F.col("total"), 3).alias("pct_rechazado"),
        *[f"motivo_{r}" for r in REASONS],
    )


def rejection_breakdown(rejections: DataFrame) -> DataFrame:
    return (
        rejections.groupBy(F.col("reason").alias("motivo"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "motivo")
    )


def trip_facts(trips: DataFrame) -> DataFrame:
    """Trips with the hour of departure and arrival."""
    return trips.select(
        "trip_id",
        "bike_id",
        "origin_station_id",
        "dest_station_id",
        "retiro_ts",
        "arribo_ts",
        "duration_min",
        S.trunc_hour(F.col("retiro_ts")).alias("retiro_hour"),
        S.trunc_hour(F.col("arribo_ts")).alias("arribo_hour"),
    )
