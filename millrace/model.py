"""What readers return besides plain DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Report:
    """Tables of one format: ``summary`` (label, value), named tables, ``warnings`` (message)."""

    summary: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: DataFrame | None = None

    def render(self, rows: int = 1000) -> dict:
        """A bounded view of all parts; missing values are shown as a dash."""
        shown = lambda df: [["-" if v is None else v for v in r] for r in df.limit(rows).collect()]
        return {
            "summary": shown(self.summary),
            "tables": {k: {"headers": df.columns, "rows": shown(df)} for k, df in self.tables.items()},
            "warnings": [] if self.warnings is None else [r[0] for r in self.warnings.limit(rows).collect()],
        }

    def to_json(self, rows: int = 1000) -> str:
        return json.dumps(self.render(rows), default=str, ensure_ascii=False)


def summary_of(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One row of values as (label, value) rows."""
    from pyspark.sql import functions as F

    return df.select(F.inline(F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for c, label in labels.items()])))
