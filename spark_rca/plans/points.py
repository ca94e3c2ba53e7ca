"""Points of a parameter grid as incidents of their own: one plan ranks all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts an incident from the number of its point; the last one of a name counts.
MARK = "~"


class Points:
    """Parameter sets (all with the same names) that late stages of a plan tell apart by the incident's name.

    Stages before ``fan`` run once for all points.  Behind it every table has one copy of its rows for each point, and ``at`` is a
    parameter's value for the row at hand; operators take it wherever they take a number for a column expression.
    """

    def __init__(self, sets: list[dict]):
        self.sets = sets

    def fan(self, df: DataFrame) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(len(self.sets) - 1)))
        return df.withColumn("_k", k).withColumn("incident_id", F.concat_ws(MARK, "incident_id", "_k")).drop("_k")

    def at(self, name: str) -> Column:
        return F.get(F.array(*[F.lit(s[name]).cast("double") for s in self.sets]), F.substring_index("incident_id", MARK, -1).cast("int"))

    def most(self, name: str) -> float:
        return max(s[name] for s in self.sets)

    def split(self, df: DataFrame, names: list[str]) -> DataFrame:
        """The rows with their incident's own name and ``params_id``, the name of their point."""
        k = F.substring_index("incident_id", MARK, -1).cast("int")
        return df.withColumn("params_id", F.get(F.array(*[F.lit(n) for n in names]), k)).withColumn("incident_id", F.regexp_replace("incident_id", f"{MARK}[0-9]+$", ""))
