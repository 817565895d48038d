"""The whole cohort: six base tables in, feature tables out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_distinct
from ..functions.temporal import age_years
from ..operators.cleaning import to_wide
from ..operators.episodes import first_episode, vent_episodes
from ..operators.events import categorize, filter_codes, union_distinct
from ..operators.infusions import charted_infusions, ordered_infusions, vasopressor_durations
from ..operators.intervals import flag_in_intervals
from ..operators.nearest import index_samples, nearest_covariates
from ..operators.running import UNBOUNDED
from ..sources.lineage import cut
from . import codes


def setting_rules() -> Mapping[str, F.Column]:
    item, value = F.col("itemid"), F.col("value")
    vent = item.isin(list(codes.VENT_SETTINGS + codes.VENT_MODE))
    for code, excluded in codes.VENT_TYPE.items():
        vent = vent | ((item == code) & (value != excluded))
    vent = vent | ((item == codes.O2_DEVICE) & (value == codes.VENT_DEVICE_VALUE))
    oxygen = F.lit(False)
    for code, values in codes.OXYGEN_VALUES.items():
        oxygen = oxygen | ((item == code) & value.isin(list(values)))
    note = item == codes.EXTUBATION_NOTE
    return {
        "MechVent": vent,
        "OxygenTherapy": oxygen,
        "Extubated": note & value.isin(codes.EXTUBATED_VALUE, codes.SELF_EXTUBATED_VALUE),
        "SelfExtubated": note & (value == codes.SELF_EXTUBATED_VALUE),
    }


def vent_settings(chart: DataFrame, procedures: DataFrame) -> DataFrame:
    """Ventilation, oxygen and extubation flags per stay and instant, from charts and procedures."""
    items = (
        tuple(codes.VENT_TYPE)
        + codes.VENT_MODE
        + codes.VENT_SETTINGS
        + (codes.EXTUBATION_NOTE, codes.O2_DEVICE)
        + codes.O2_DELIVERY
    )
    rows = filter_codes(chart, "itemid", items).where(
        F.col("value").isNotNull() & is_distinct("error", 1)
    )
    done = filter_codes(procedures, "itemid", codes.PROCEDURE_EXTUBATIONS)
    # Both tables' rows are united and grouped once. The procedures' stored columns come first and as they are: Spark then
    # sees that a union of tables stored by stay is still dealt by stay. Charts carry their flags as bits of a negative code.
    rules = setting_rules()
    bits = {name: 1 << n for n, name in enumerate(rules)}
    marks = reduce(Column.__add__, [F.when(rule, bits[name]).otherwise(0) for name, rule in rules.items()])
    every = done.select("icustay_id", "itemid", "starttime").union(rows.select("icustay_id", -1 - marks, "charttime"))
    code = F.col("itemid")
    charted, themselves = code < 0, code == codes.PROCEDURE_SELF_EXTUBATION
    grouped = every.groupBy("icustay_id", "starttime").agg(
        *[F.max(F.when(charted, ((-1 - code).bitwiseAND(bit) > 0).cast("int"))).alias(name) for name, bit in bits.items()],
        F.max(charted).alias("__charted"),
        F.max(~charted & ~themselves).alias("__done"),
        F.max(themselves).alias("__done_self"),
    )

    def extubation(own: int) -> F.Column:
        flags = {"Extubated": 1, "SelfExtubated": own}
        return F.struct(*[F.lit(flags.get(name, 0)).alias(name) for name in rules])

    # One row for the charts of an instant, one for each kind of procedure; equal rows are one.
    kinds = F.array(
        F.when(F.col("__charted"), F.struct(*rules)),
        F.when(F.col("__done"), extubation(0)),
        F.when(F.col("__done_self"), extubation(1)),
    )
    flags = F.inline(F.array_distinct(F.filter(kinds, lambda row: row.isNotNull())))
    return grouped.select("icustay_id", F.col("starttime").alias("charttime"), flags)


def chart_covariates(chart: DataFrame, index: DataFrame, in_place: bool = False) -> DataFrame:
    """Per stay and category the chart row nearest to the index time, at most two hours away."""
    items = [code for group in codes.CHART_CATEGORIES.values() for code in group]
    events = categorize(
        filter_codes(chart, "itemid", items).select(
            "subject_id", "icustay_id", "itemid", "charttime", "value", "valueuom"
        ),
        "itemid",
        codes.CHART_CATEGORIES,
    )
    picked = nearest_covariates(
        events,
        index.select("icustay_id", F.col("charttime").alias("pick_charttime"), "starttime", "endtime"),
        on=["icustay_id"],
        by=["subject_id", "icustay_id"],
        pick="pick_charttime",
        first_only=True,
        keep=(F.col("min_time_diff") <= codes.CHART_MAX_GAP) & F.col("value").isNotNull(),
        in_place=in_place,
    )
    return picked.select(
        "subject_id", "icustay_id", "itemid", "category", "value", "valueuom",
        "charttime", "pick_charttime", "starttime", "endtime", "min_time_diff",
    )


def lab_covariates(labs: DataFrame, index: DataFrame, in_place: bool = False) -> DataFrame:
    """Per patient and category the labs of the index instant; hemoglobin may be a day away."""
    items = [code for group in codes.LAB_CATEGORIES.values() for code in group]
    events = categorize(
        filter_codes(labs, "itemid", items).select(
            "subject_id", "itemid", "charttime", "value", "valueuom"
        ),
        "itemid",
        codes.LAB_CATEGORIES,
    )
    gap = F.col("min_time_diff")
    picked = nearest_covariates(
        events,
        index.select("subject_id", F.col("labtime").alias("pick_labtime"), "starttime", "endtime"),
        on=["subject_id"],
        by=["subject_id"],
        pick="pick_labtime",
        first_only=False,
        keep={"Hemoglobin": gap <= codes.HEMOGLOBIN_MAX_GAP},
        default=gap == 0,
        in_place=in_place,
    )
    return picked.select(
        "subject_id", "itemid", "category", "value", "valueuom",
        "charttime", "pick_labtime", "starttime", "endtime", "min_time_diff",
    )


def long_covariates(chart_rows: DataFrame, lab_rows: DataFrame) -> DataFrame:
    return union_distinct(
        chart_rows.drop("icustay_id"), lab_rows.withColumnRenamed("pick_labtime", "pick_charttime")
    )


def add_age_gender(df: DataFrame, patients: DataFrame, ts: str = "charttime") -> DataFrame:
    """Patient attributes and age at ``ts``; Spark broadcasts the patients only while they are small."""
    people = patients.select("subject_id", "dob", "gender")
    return df.join(people, "subject_id").withColumn("age", age_years(ts, "dob"))


def add_vasopressor_flag(demographics: DataFrame, durations: DataFrame) -> DataFrame:
    """One row per demographic row and vasopressor interval of the stay, flagged '1' inside of it."""
    intervals = durations.select(
        "icustay_id", "vasonum", F.col("starttime").alias("veso_start"), F.col("endtime").alias("veso_end")
    )
    flagged = flag_in_intervals(
        demographics, intervals, ["icustay_id"], "pick_charttime", "veso_start", "veso_end", name="__in"
    )
    return flagged.withColumn("Vesopression_infussion", F.col("__in").cast("string")).drop("__in")


def vasopressors(
    charted: DataFrame, ordered: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    return vasopressor_durations(
        charted_infusions(
            filter_codes(charted, "itemid", codes.CHARTED_VASOPRESSORS),
            codes.SWAPPED_RATE_AMOUNT,
            codes.STOP_WORDS,
            hot_rows=hot_rows,
        ),
        ordered_infusions(
            filter_codes(ordered, "itemid", codes.ORDERED_VASOPRESSORS), codes.VOID_ORDER_STATUS
        ),
        hot_rows=hot_rows,
    )


class Cohort:
    """All feature tables of a set of base tables; each is built when it is first asked for.

    ``reuse`` is applied to the results that several others read. ``in_place`` is for tables stored by stay
    and patient without very large ones (``layout.StayLayout``): base tables are then not exchanged.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        reuse: Callable[[DataFrame], DataFrame] = cut,
        hot_rows: int | None = None,
        in_place: bool = False,
    ):
        self.tables, self._reuse, self._in_place = tables, reuse, in_place
        self._hot_rows = UNBOUNDED if in_place else hot_rows

    @cached_property
    def settings(self) -> DataFrame:
        return vent_settings(self.tables["chartevents"], self.tables["procedureevents_mv"])

    @cached_property
    def episodes(self) -> DataFrame:
        return self._reuse(
            vent_episodes(self.settings, gap=codes.EPISODE_GAP, hot_rows=self._hot_rows)
        )

    @cached_property
    def index_samples(self) -> DataFrame:
        return self._reuse(
            index_samples(
                filter_codes(self.tables["chartevents"], "itemid", codes.SPO2),
                filter_codes(self.tables["labevents"], "itemid", codes.PAO2),
                first_episode(self.episodes),
                cap=codes.EPISODE_CAP,
                max_gap=codes.INDEX_MAX_GAP,
                hot_rows=self._hot_rows,
                in_place=self._in_place,
            )
        )

    @cached_property
    def chart_covariates(self) -> DataFrame:
        return self._reuse(chart_covariates(self.tables["chartevents"], self.index_samples, self._in_place))

    @cached_property
    def lab_covariates(self) -> DataFrame:
        return lab_covariates(self.tables["labevents"], self.index_samples, self._in_place)

    @cached_property
    def long_covariates(self) -> DataFrame:
        return long_covariates(self.chart_covariates, self.lab_covariates)

    @cached_property
    def vasopressor_durations(self) -> DataFrame:
        return vasopressors(
            self.tables["inputevents_cv"], self.tables["inputevents_mv"], self._hot_rows
        )

    @cached_property
    def age_gender(self) -> DataFrame:
        return add_age_gender(self.chart_covariates, self.tables["patients"])

    @cached_property
    def age_gender_vaso(self) -> DataFrame:
        return add_vasopressor_flag(self.age_gender, self.vasopressor_durations)


def wide_samples(cohort: Cohort) -> DataFrame:
    """Model input from the cohort's tables: one row per sample (a patient's episode), a column per category."""
    inside = flag_in_intervals(
        cohort.age_gender, cohort.vasopressor_durations, ["icustay_id"], "charttime", how="left", name="vaso", collapse=True
    )
    return to_wide(cohort.long_covariates, inside.select("subject_id", "starttime", "gender", "age", "vaso"))
