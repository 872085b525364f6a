"""US federal holidays generated by rule as Spark date expressions.

The reference looked holidays up in a Python package that is not available
here; the same table follows from the public federal rules (5 U.S.C. 6103):
fixed dates, n-th weekday of a month, last Monday of May, and the
observed-day shift for fixed dates that fall on a weekend (Saturday ->
Friday before, Sunday -> Monday after).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The holiday rules. weekday uses Spark's numbering
# (Sunday = 1 ... Saturday = 7); n = 1..4 is the n-th such weekday of the
# month and n = -1 the last one. since/until bound the years a rule applies.
# (name, month, day, weekday, n, since, until, observed_shift)
HOLIDAY_RULES = [
    ("New Year's Day", 1, 1, None, None, 1871, 9999, True),
    ("Martin Luther King Jr. Day", 1, None, 2, 3, 1986, 9999, False),
    ("Washington's Birthday", 2, None, 2, 3, 1971, 9999, False),
    ("Memorial Day", 5, None, 2, -1, 1971, 9999, False),
    ("Juneteenth National Independence Day", 6, 19, None, None, 2021, 9999, True),
    ("Independence Day", 7, 4, None, None, 1871, 9999, True),
    ("Labor Day", 9, None, 2, 1, 1894, 9999, False),
    ("Columbus Day", 10, None, 2, 2, 1971, 9999, False),
    ("Veterans Day", 10, None, 2, 4, 1971, 1977, False),
    ("Veterans Day", 11, 11, None, None, 1978, 9999, True),
    ("Thanksgiving", 11, None, 5, 4, 1871, 9999, False),
    ("Christmas Day", 12, 25, None, None, 1871, 9999, True),
]
OBSERVED_SUFFIX = " (Observed)"

_RULE_TYPE = ("struct<name:string,month:int,day:int,weekday:int,n:int,"
              "since:int,until:int,observed:boolean>")


def _rules_literal():
    rows = []
    for name, month, day, weekday, n, since, until, observed in HOLIDAY_RULES:
        rows.append(F.struct(
            F.lit(name).alias("name"), F.lit(month).cast("int").alias("month"),
            F.lit(day).cast("int").alias("day"), F.lit(weekday).cast("int").alias("weekday"),
            F.lit(n).cast("int").alias("n"), F.lit(since).alias("since"),
            F.lit(until).alias("until"), F.lit(observed).alias("observed")))
    return F.array(*rows).cast(f"array<{_RULE_TYPE}>")


def us_holidays(years: DataFrame, year_col: str = "year") -> DataFrame:
    """Holiday table ``(date timestamp_ntz, holiday string)``: the holidays whose date lies in the given years.

    The 31st of December is the observed New Year of the year after where
    that falls on a Saturday, so the rules of the next year are applied too.

    ``years`` is any DataFrame with a year column (for example the distinct
    years of a calendar); each year row expands to its holidays, so the work
    is a projection, not a join.
    """
    y = F.col(year_col).cast("int")
    r = (years.select(y.alias("of"), F.explode(F.array(y, y + 1)).alias("y"))
         .select("of", "y", F.explode(_rules_literal()).alias("r")))
    r = r.filter((F.col("y") >= F.col("r.since")) & (F.col("y") <= F.col("r.until")))
    first = F.make_date("y", "r.month", F.lit(1))
    last = F.last_day(first)
    nth = F.date_add(first, ((F.col("r.weekday") - F.dayofweek(first) + 7) % 7
                             + (F.col("r.n") - 1) * 7).cast("int"))
    final = F.date_sub(last, ((F.dayofweek(last) - F.col("r.weekday") + 7) % 7).cast("int"))
    actual = (F.when(F.col("r.day").isNotNull(), F.make_date("y", "r.month", "r.day"))
              .when(F.col("r.n") == -1, final)
              .otherwise(nth))
    d = r.select("of", "r.name", "r.observed", actual.alias("d"))
    dow = F.dayofweek("d")
    shifted = (F.when(dow == 7, F.date_sub("d", 1)).when(dow == 1, F.date_add("d", 1)))
    entries = F.array(
        F.struct(F.col("d").alias("d"), F.col("name").alias("holiday")),
        F.when(F.col("observed") & shifted.isNotNull(),
               F.struct(shifted.alias("d"), F.concat("name", F.lit(OBSERVED_SUFFIX)).alias("holiday"))),
    )
    out = d.select("of", F.explode(entries).alias("e")).filter(F.col("e").isNotNull() & (F.year("e.d") == F.col("of")))
    return out.select(F.col("e.d").cast("timestamp_ntz").alias("date"), F.col("e.holiday").alias("holiday"))
