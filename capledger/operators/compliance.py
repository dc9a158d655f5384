"""Who is covered, and what their emissions mean under each period's cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.functions.columns import AMOUNT, quantity

# The verdict of one entity in one period.
COMPLIANT, EXCEEDS, NO_CAP = "compliant", "exceeds", "cap_unavailable"


def is_covered(listed: Column, area: Column, threshold: Column) -> Column:
    """On the list, or strictly larger than the threshold; unknown sizes are not covered."""
    return F.coalesce(listed, F.lit(False)) | F.coalesce(quantity(area) > threshold, F.lit(False))


def project_compliance(
    df: DataFrame, cap: str = "cap", actual: str = "actual", penalty_rate: Column | None = None,
) -> DataFrame:
    """Adds status, excess, penalty_rate and penalty.

    Without a cap there is no excess and no penalty. Without a penalty rate there
    is an excess and no penalty. The status is decided on exact decimals.
    """
    rate = (F.lit(None) if penalty_rate is None else penalty_rate).cast("decimal(12,4)")
    over = (F.col(actual) - F.col(cap)).cast(AMOUNT)
    excess = F.when(F.col(cap).isNull(), None).when(over > 0, over).otherwise(F.lit(0).cast(AMOUNT))
    return df.withColumn("excess", excess).withColumns({
        "status": F.when(F.col("excess").isNull(), NO_CAP)
        .when(F.col("excess") == 0, COMPLIANT)
        .otherwise(EXCEEDS),
        "penalty_rate": rate,
        "penalty": F.col("excess").cast("decimal(27,12)") * rate,
    })
