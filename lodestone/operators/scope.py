"""Access scope as predicates that are pushed to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the classification levels.
LEVELS = {"INTERNAL": 0, "RESTRICTED": 10, "CONFIDENTIAL": 20, "SECRET": 30}


def level(name: Column) -> Column:
    """The level of a name in any case; null for unknown and empty names."""
    return F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[F.upper(name)]


def scoped(df: DataFrame, organization: int | None = None, workspace: int | None = None, clearance: int | None = None, generation: str | None = None, fail_closed: bool = True) -> DataFrame:
    """df restricted by each given part of a scope whose column it has. An unknown classification is kept only if not fail_closed."""
    for name, value in (("organization_id", organization), ("workspace_id", workspace), ("generation_id", generation)):
        if value is not None and name in df.columns:
            df = df.where(F.col(name) == value)
    if clearance is not None and "classification_level" in df.columns:
        ok = F.col("classification_level") <= clearance
        df = df.where(ok if fail_closed else ok | F.col("classification_level").isNull())
    return df


def drop_reason(organization: int, workspace: int, clearance: int, generation: str) -> Column:
    """The first rule that a row fails, or null."""
    return (
        F.when(F.col("organization_id") != organization, "tenant_acl").when(F.col("workspace_id") != workspace, "workspace_acl").when(F.col("classification_level").isNull(), "classification_unknown")
        .when(F.col("classification_level") > clearance, "classification").when(F.col("generation_id").isNull(), "generation_required").when(F.col("generation_id") != generation, "generation_mismatch")
    )


def with_scope(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scope columns derived from a numeric key, for tables that have none."""
    k = F.col(key)
    return df.withColumns({"organization_id": k % 3, "workspace_id": k % 7, "classification_level": F.when(k % 11 != 0, k % 4 * 10), "generation_id": F.concat(F.lit("G00"), (1 + k % 2).cast("string"))})
