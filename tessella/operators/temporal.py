"""Bi-temporal visibility, scope and eligibility predicates, and interval operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.model import NOW


def visible(valid_at: float = NOW, known_at: float = NOW) -> Column:
    """Rows that hold at ``valid_at`` as far as was known at ``known_at``; intervals are half open."""
    c = F.col
    return (
        (c("valid_from").isNull() | (c("valid_from") <= valid_at))
        & (c("valid_to").isNull() | (c("valid_to") > valid_at) | (c("valid_to_recorded_at").isNotNull() & (c("valid_to_recorded_at") > known_at)))
        & (c("ingested_at").isNull() | (c("ingested_at") <= known_at))
        & (c("expired_at").isNull() | (c("expired_at") > known_at))
    )


def visible_sql(valid_at: float = NOW, known_at: float = NOW, p: str = "") -> str:
    return (
        f"({p}valid_from IS NULL OR {p}valid_from <= {valid_at}::DOUBLE) AND ({p}valid_to IS NULL OR {p}valid_to > {valid_at}::DOUBLE OR ({p}valid_to_recorded_at IS NOT NULL AND {p}valid_to_recorded_at > {known_at}::DOUBLE)) "
        f"AND ({p}ingested_at IS NULL OR {p}ingested_at <= {known_at}::DOUBLE) AND ({p}expired_at IS NULL OR {p}expired_at > {known_at}::DOUBLE)"
    )


@dataclass(frozen=True)
class SearchFilter:
    """Where and when to read; None means everything, an empty list nothing."""

    workspace_id: str | None = None
    repo_id: str | None = None
    session_id: str | None = None
    include_ancestors: bool = True
    scopes: tuple[str, ...] | None = None
    mtypes: tuple[str, ...] | None = None
    valid_at: float = NOW
    known_at: float = NOW
    as_of: float | None = None
    include_invalid: bool = False

    def __post_init__(self) -> None:
        if self.as_of is not None and self.valid_at not in (NOW, self.as_of):
            raise ValueError("as_of and valid_at differ")

    def predicate(self) -> Column:
        """One condition that Spark can push to the scan."""
        out = F.lit(True)
        if self.workspace_id is not None:
            out &= F.col("workspace_id") == self.workspace_id
        out &= self._place()
        for column, values in (("scope", self.scopes), ("mtype", self.mtypes)):
            if values is not None:
                out &= F.col(column).isin(list(values)) if values else F.lit(False)
        if not self.include_invalid:
            out &= visible(self.valid_at if self.as_of is None else self.as_of, self.known_at)
        return out

    def _place(self) -> Column:
        scope = F.col("scope")
        if not self.include_ancestors:
            out = F.lit(True)
            if self.repo_id is not None:
                out &= F.col("repo_id") == self.repo_id
            if self.session_id is not None:
                out &= F.col("session_id") == self.session_id
            return out
        wide = scope.isin("workspace", "user")
        if self.session_id is not None:
            own = (scope == "session") & (F.col("session_id") == self.session_id)
            return own | ((scope == "repo") & (F.col("repo_id") == self.repo_id)) | wide
        if self.repo_id is not None:
            return ((scope == "repo") & (F.col("repo_id") == self.repo_id)) | wide
        return scope != "session" if self.workspace_id is not None else F.lit(True)


def supersession(claims: DataFrame, keys: list[str], start: str, tie: str) -> DataFrame:
    """Close each claim where its successor of the same key begins."""
    order = Window.partitionBy(*keys).orderBy(start, tie)
    return claims.withColumn("valid_to", F.lead(start).over(order)).withColumn("version", F.row_number().over(order))


def live_unique(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One live row for each key: the first in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
