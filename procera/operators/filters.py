"""Filter state compiled to one predicate, and text search."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procera.schema import CHIP_LABELS, MONTH, has

RECORD_SEARCH = ("nome", "prontuario", "cpf", "cirurgiao", "municipio")
PATIENT_SEARCH = ("nome", "prontuario", "cpf")


@dataclass(frozen=True)
class Filters:
    """Empty selections do not filter; `period` filters only as a pair of dates."""

    tipo_procedimento: tuple[str, ...] = ()
    cirurgiao: tuple[str, ...] = ()
    municipio: tuple[str, ...] = ()
    lateralidade: tuple[str, ...] = ()
    tipo_atendimento: tuple[str, ...] = ()
    period: tuple[dt.date, ...] | None = None
    end_of_day: bool = False

    MEMBERSHIP = ("tipo_procedimento", "cirurgiao", "municipio", "lateralidade", "tipo_atendimento")

    @classmethod
    def default(cls, df: DataFrame) -> Filters:
        """What an untouched date picker selects: the whole range present in `df`."""
        low, high = df.agg(F.min("data_inicio"), F.max("data_inicio")).first()
        return cls() if low is None else cls(period=(low.date(), high.date()))

    def active(self) -> int:
        """Selections in force; the period is not counted."""
        return sum(bool(getattr(self, name)) for name in self.MEMBERSHIP)

    def chips(self) -> list[str]:
        return [f"{CHIP_LABELS[name]}: {value}" for name in self.MEMBERSHIP for value in getattr(self, name)]

    def cleared(self) -> Filters:
        return replace(self, **dict.fromkeys(self.MEMBERSHIP, ()))

    def predicate(self, df: DataFrame) -> Column:
        parts = [F.col(name).isin(list(getattr(self, name))) for name in self.MEMBERSHIP if getattr(self, name) and has(df, name)]
        if self.period is not None and len(self.period) == 2 and has(df, "data_inicio"):
            low, high = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in self.period)
            if has(df, MONTH):  # tables kept by month: only these folders are read
                parts.append(F.col(MONTH).between(*(f"{d:%Y-%m}" for d in self.period)))
            parts.append(F.col("data_inicio") >= low)
            if self.end_of_day:
                after = self.period[1] + dt.timedelta(days=1)
                parts.append(F.col("data_inicio") < F.lit(after.isoformat()).cast("timestamp_ntz"))
            else:
                parts.append(F.col("data_inicio") <= high)
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(df))


class SearchPatternError(ValueError):
    """The search term is not a usable regular expression."""


def search(df: DataFrame, term: str, columns: tuple[str, ...] = RECORD_SEARCH, literal: bool = False) -> DataFrame:
    """Rows where any of `columns` contains `term`, ignoring case.

    By default the upper-cased term is a regular expression and NULL reads as
    the text ``None``. `literal` takes the term as plain text and never matches NULL.
    """
    present = [c for c in columns if has(df, c)]
    if not term:
        return df
    if not literal:
        try:
            re.compile(term.upper())
            df.sparkSession._jvm.java.util.regex.Pattern.compile(term.upper())
        except Exception as e:
            raise SearchPatternError(f"not a regular expression: {term!r}") from e
        hits = [F.upper(F.coalesce(F.col(c).cast("string"), F.lit("None"))).rlike(term.upper()) for c in present]
    else:
        hits = [F.upper(F.col(c).cast("string")).contains(term.upper()) for c in present]
    return df.where(reduce(lambda a, b: a | b, hits, F.lit(False)))


def patient_search(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    return search(df, term, PATIENT_SEARCH, literal)
