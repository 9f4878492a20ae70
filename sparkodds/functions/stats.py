"""Price buckets, Wilson intervals, fees and banding as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.timefn import col

# Fee coefficients of the two venues (taker, maker).
VENUE_A_TAKER = 0.07
VENUE_A_MAKER = 0.0175
VENUE_B_TAKER = 0.06
VENUE_B_MAKER = -0.0125


def price_bucket(p: Column | str, buckets: int = 10) -> Column:
    """Bucket index 0..buckets-1 of a probability; 1.0 falls in the last one."""
    return F.least(F.floor(col(p) * buckets), F.lit(buckets - 1)).cast("int")


def wilson(p_hat: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval (low, high) of a proportion seen over n trials."""
    p_hat, n = col(p_hat), col(n)
    z2 = z * z
    scale = 1 + z2 / n
    middle = (p_hat + z2 / (2 * n)) / scale
    reach = z * F.sqrt(p_hat * (1 - p_hat) / n + z2 / (4 * n * n)) / scale
    return middle - reach, middle + reach


def with_deviation(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Add the win rate's Wilson interval, its deviation from the average price,
    and that deviation's interval."""
    lo, hi = wilson("win_rate", "n_samples", z)
    return df.withColumns({"ci_lo": lo, "ci_hi": hi}).withColumns(
        {
            "deviation": F.col("win_rate") - F.col("avg_price"),
            "dev_lo": F.col("ci_lo") - F.col("avg_price"),
            "dev_hi": F.col("ci_hi") - F.col("avg_price"),
        }
    )


def fee(p: Column | str, theta: float) -> Column:
    """Fee per contract on the quadratic curve theta * p * (1 - p)."""
    return F.lit(theta) * col(p) * (1 - col(p))


def round_trip_fee(p: Column | str, maker: bool = False) -> Column:
    """Both legs' fees at one price."""
    a, b = (VENUE_A_MAKER, VENUE_B_MAKER) if maker else (VENUE_A_TAKER, VENUE_B_TAKER)
    return fee(p, a) + fee(p, b)


def cost_band(p: Column | str, half_spread: Column | float, theta: float = VENUE_A_TAKER) -> Column:
    """Cost of taking at price p: taker fee plus half the spread."""
    return fee(p, theta) + half_spread


def band(value: Column | str, uppers: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first band whose upper bound is above the value; the last
    label takes the rest. NULL stays NULL."""
    value = col(value)
    expr = F.when(value < uppers[0], labels[0])
    for upper, label in zip(uppers[1:], labels[1:]):
        expr = expr.when(value < upper, label)
    return expr.when(value.isNotNull(), labels[-1])


def regroup(value: Column | str, groups: dict[str, Sequence[str]], other: str = "other") -> Column:
    """Map category values to group labels, everything else to ``other``."""
    value = col(value)
    expr = None
    for label, members in groups.items():
        hit = value.isin(*members)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(other)


# Weather groups and bands.
CONDITION_GROUPS = {
    "clear": ["Clear", "Sunny"],
    "clouds": ["Partly Cloudy", "Cloudy", "Overcast"],
    "roof/dome": ["Roof Closed", "Dome"],
    "rain": ["Rain", "Drizzle"],
}
TEMP_UPPERS, TEMP_LABELS = [60, 70, 80], ["< 60°F", "60–69°F", "70–79°F", "80°F+"]
WIND_UPPERS, WIND_LABELS = [5, 10], ["0–4 mph", "5–9 mph", "10+ mph"]


def condition_group(c: Column | str = "condition") -> Column:
    return regroup(c, CONDITION_GROUPS)


def temp_band(c: Column | str = "temp_f") -> Column:
    return band(c, TEMP_UPPERS, TEMP_LABELS)


def wind_band(c: Column | str = "wind_mph") -> Column:
    return band(c, WIND_UPPERS, WIND_LABELS)


def wind_mph(c: Column | str = "wind") -> Column:
    """Miles per hour out of text such as '8 mph, Out To CF'."""
    return F.nullif(F.regexp_extract(col(c), r"(\d+) mph", 1), F.lit("")).try_cast("int")


def cents(price: Column | str) -> Column:
    """Whole cents of a dollar price, rounded (a plain cast would truncate)."""
    return F.round(col(price) * 100, 0).cast("bigint")
