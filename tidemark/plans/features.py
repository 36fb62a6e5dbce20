"""The feature matrix: statistics are fitted on training rows, history columns see all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import scalar
from tidemark.operators import encode, pit

PIT_PREFIX, TE_SUFFIX = "uid_", "_te"
FIT_SUFFIXES = ("_freq", "_te", "_code")


def lagged(df: DataFrame, columns: list[str], prior: float, lag: float, smoothing: float) -> DataFrame:
    return pit.lagged_target_encoding(df, schema.ID, schema.TIME, schema.TARGET, columns, prior, lag, smoothing)


def leaky(df: DataFrame, columns: list[str], prior: float, lag: float, smoothing: float) -> DataFrame:
    """A strategy that sees the future: the control that audits must catch."""
    return pit.full_target_encoding(df, schema.ID, schema.TARGET, columns, prior, smoothing)


def is_point_in_time(feature: str) -> bool:
    return feature.startswith(PIT_PREFIX) or feature.endswith(TE_SUFFIX)


def depends_on_fit(feature: str) -> bool:
    return feature.endswith(FIT_SUFFIXES) or feature == "amt_decile"


class FeatureBuilder:
    """fit(train rows), then transform(all rows); columns that a frame lacks are left out.

    Target encodings exist only where the label does. ``target_encoding`` is a strategy, so that audits can plant
    a leaking one.
    """

    def __init__(self, lag_days: float = schema.LABEL_LAG_DAYS, smoothing: float = schema.SMOOTHING, target_encoding: Callable[..., DataFrame] = lagged, strict_ties: bool = False):
        self.lag, self.smoothing, self.target_encoding, self.strict_ties = lag_days * schema.DAY, smoothing, target_encoding, strict_ties
        self.fitted = False

    @staticmethod
    def _keyed(df: DataFrame) -> DataFrame:
        """Interaction keys and reference days, which later columns build on."""
        held, t = set(df.columns), F.col(schema.TIME)
        pairs = {f"{a}_x_{b}": scalar.composite_key(F.col(a), F.col(b)) for a, b in schema.INTERACTIONS if {a, b} <= held}
        days = {f"{c}_ref_day": scalar.ref_day(t, F.col(c)) for c in schema.present(held, schema.REF_DAY)}
        return df.withColumns(pairs | days)

    def _frequency_columns(self, df: DataFrame) -> list[str]:
        return schema.present(df.columns, [*schema.FREQUENCY, *(f"{a}_x_{b}" for a, b in schema.INTERACTIONS)])

    def fit(self, train: DataFrame) -> FeatureBuilder:
        keyed = self._keyed(train)
        self.edges = encode.quantile_edges(keyed, schema.AMOUNT) if schema.AMOUNT in keyed.columns else []
        self.frequency = self._frequency_columns(keyed)
        self.codes = schema.present(keyed.columns, schema.CATEGORICAL)
        columns = sorted({*self.frequency, *self.codes})
        self.levels, self.sizes = encode.level_tables(keyed, columns, schema.TIME, schema.ID) if columns else (None, {})
        self.prior = encode.prior(keyed, schema.TARGET) if schema.TARGET in keyed.columns else None
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Row id and features; the time, the label and raw categories are not among them."""
        if not self.fitted:
            raise RuntimeError("fit before transform")
        keyed = self._keyed(df)
        held, t, amount = set(keyed.columns), F.col(schema.TIME), F.col(schema.AMOUNT).cast("double")
        out: dict[str, Column] = {}
        if schema.AMOUNT in held:
            edges = F.array(*(F.lit(e) for e in self.edges)) if self.edges else F.array().cast("array<double>")
            out |= {"amt_log": scalar.amount_log(amount), "amt_decimal": scalar.amount_decimal(amount), "amt_is_round": scalar.amount_is_round(amount), "amt_decile": scalar.decile(amount, edges)}
        out |= {"dt_hour_assumed": scalar.hour_of(t), "dt_dow_assumed": scalar.weekday_of(t)}
        if "has_identity_record" in held:
            out["has_identity_record"] = F.col("has_identity_record").cast("int")
        out |= {f"{c}_isnull": scalar.is_null(F.col(c)) for c in schema.present(held, schema.ISNULL)}
        days = [f"{c}_ref_day" for c in schema.present(held, schema.REF_DAY)]
        for prefix, keys in schema.ENTITIES.items():
            keys = schema.present(held, keys)
            if keys and schema.AMOUNT in held:
                out |= pit.entity_columns(prefix, keys, schema.TIME, schema.ID, schema.AMOUNT, self.strict_ties)
        numeric = schema.present(held, [c for block in schema.NUMERIC_BLOCKS.values() for c in block])
        raw = {c: F.col(c).cast("float") for c in numeric}
        wanted: dict[str, list] = {}
        for c in self.frequency:
            wanted.setdefault(c, []).append((f"{c}_freq", "n", 0))
        for c in self.codes:
            wanted.setdefault(c, []).append((f"{c}_code", "code", -1))
        wanted = {c: outputs for c, outputs in wanted.items() if c in held}
        wide = keyed.select(schema.ID, *days, *(F.col(c).alias(f"__k_{c}") for c in wanted), *(c.alias(n) for n, c in (out | raw).items()))
        wide = encode.lookup_levels(wide, self.levels, self.sizes, wanted, "__k_{}")
        wide = wide.select(*(c for c in wide.columns if not c.startswith("__k_")))
        encoded = schema.present(held, schema.TARGET_ENCODED)
        if self.prior is None or schema.TARGET not in held or not encoded:
            return wide
        te = self.target_encoding(keyed, encoded, self.prior, self.lag, self.smoothing)  # narrow; NULL is a level
        return wide.join(te.select(schema.ID, *(F.col(f"{c}_te").cast("float").alias(f"{c}_te") for c in encoded)), schema.ID, "left")


def build_feature_matrix(df: DataFrame, train_mask: Column, **options) -> tuple[DataFrame, FeatureBuilder]:
    builder = FeatureBuilder(**options).fit(df.where(train_mask))
    return builder.transform(df), builder


def view_columns(columns: list[str], view: str) -> list[str]:
    """base: without compressed V columns; unsup: all; compact: without raw V columns. The id is never a feature."""
    kept = [c for c in columns if c not in (schema.ID, schema.TIME, schema.TARGET)]
    compressed = lambda c: c.startswith("vpca_") or c.startswith("v_cluster")
    if view == "base":
        return [c for c in kept if not compressed(c)]
    if view == "unsup":
        return kept
    if view == "compact":
        return [c for c in kept if not (c[:1] == "V" and c[1:].isdigit())]
    raise ValueError(f"no view {view!r}; there are base, unsup and compact")


def attach(features: DataFrame, more: DataFrame, key: str = schema.ID) -> DataFrame:
    """Join two matrices on the row id; raises unless both hold the same rows."""
    out = features.join(more, key)
    n = {features.count(), more.count(), out.count()}
    if len(n) != 1:
        raise ValueError("the matrices do not hold the same rows")
    return out
