"""Scoring rule and numeric helpers as pure Column expressions (whole-stage codegen).

The rule: an exact score earns EXACT_POINTS and nothing else; otherwise the same
winner class earns WINNER_POINTS, and each side within CLOSE_MARGIN of the actual
score earns CLOSE_POINTS. A NULL actual score falls to the TIE class and never
matches exactly or closely, so a predicted tie against an unplayed game scores 3.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rule.
EXACT_POINTS = 10
WINNER_POINTS = 3
CLOSE_POINTS = 1
CLOSE_MARGIN = 2
POINT_VALUES = (0, 1, 2, 3, 4, 5, 10)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def winner_class(home, away) -> Column:
    home, away = _c(home), _c(away)
    return F.when(home > away, F.lit("HOME")).when(away > home, F.lit("AWAY")).otherwise(F.lit("TIE"))


def _flag(cond: Column, points: int) -> Column:
    # NULL conditions count as false, like an IF in a stored function.
    return F.when(cond, F.lit(points)).otherwise(F.lit(0))


def prediction_points(pred_home, pred_away, actual_home, actual_away) -> Column:
    ph, pa, ah, aa = map(_c, (pred_home, pred_away, actual_home, actual_away))
    graded = (_flag(winner_class(ph, pa) == winner_class(ah, aa), WINNER_POINTS)
              + _flag(F.abs(ph - ah) <= CLOSE_MARGIN, CLOSE_POINTS)
              + _flag(F.abs(pa - aa) <= CLOSE_MARGIN, CLOSE_POINTS))
    return F.when((ph == ah) & (pa == aa), F.lit(EXACT_POINTS)).otherwise(graded).cast("bigint")


def round_ratio_2dp(numerator, denominator, scale: int = 1) -> Column:
    """ROUND(scale * num / den, 2) computed half-up on integers, as DOUBLE.

    floor((200*scale*num + den) / (2*den)) / 100 is exact for non-negative integers and
    identical in every engine, unlike double ROUND.
    """
    num, den = _c(numerator), _c(denominator)
    return (F.floor((F.lit(200 * scale) * num + den) / (F.lit(2) * den)) / F.lit(100)).cast("double")


def register_sql_functions(spark) -> None:
    """Expose the rule to SQL users as SQL-bodied functions (inlined, no Python UDF)."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION winner_class(h BIGINT, a BIGINT) RETURNS STRING
        RETURN CASE WHEN h > a THEN 'HOME' WHEN a > h THEN 'AWAY' ELSE 'TIE' END""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION prediction_points(
            ph BIGINT, pa BIGINT, ah BIGINT, aa BIGINT) RETURNS BIGINT
        RETURN CAST(CASE WHEN ph = ah AND pa = aa THEN {EXACT_POINTS} ELSE
            (CASE WHEN winner_class(ph, pa) = winner_class(ah, aa) THEN {WINNER_POINTS} ELSE 0 END)
          + (CASE WHEN abs(ph - ah) <= {CLOSE_MARGIN} THEN {CLOSE_POINTS} ELSE 0 END)
          + (CASE WHEN abs(pa - aa) <= {CLOSE_MARGIN} THEN {CLOSE_POINTS} ELSE 0 END) END AS BIGINT)""")
