"""Request-payload rules as Column expressions that yield a reject reason or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the payload rules.
USERNAME_MIN, USERNAME_MAX = 3, 50
GROUP_NAME_MIN, GROUP_NAME_MAX = 3, 100
GROUP_CODE_LEN = 6
# letters/digits plus '_' and '-', with at least one letter or digit
USERNAME_PATTERN = r"^[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first failing rule's reason, NULL when all pass (rule order matters)."""
    expr = None
    for cond, reason in reversed(rules):
        expr = F.when(cond, F.lit(reason)) if expr is None else F.when(cond, F.lit(reason)).otherwise(expr)
    return expr


def registration_reason(username, email) -> Column:
    u, e = _c(username), _c(email)
    return first_reason(
        (u.isNull() | (u == ""), "username empty"),
        ((F.length(u) < USERNAME_MIN) | (F.length(u) > USERNAME_MAX), "username length"),
        (~u.rlike(USERNAME_PATTERN), "username characters"),
        (e.isNull() | (e == ""), "email empty"),
        (~e.rlike(EMAIL_PATTERN), "email invalid"),
    )


def prediction_payload_reason(group_id, fixture_id, pred_home, pred_away) -> Column:
    return first_reason(
        (_c(group_id).isNull() | (_c(group_id) <= 0), "group_id must be > 0"),
        (_c(fixture_id).isNull() | (_c(fixture_id) <= 0), "fixture_id must be > 0"),
        (_c(pred_home).isNull() | (_c(pred_home) < 0), "pred_home_score must be >= 0"),
        (_c(pred_away).isNull() | (_c(pred_away) < 0), "pred_away_score must be >= 0"),
    )


def group_payload_reason(group_name, group_code) -> Column:
    n, c = _c(group_name), _c(group_code)
    return first_reason(
        (n.isNull() | (F.length(n) < GROUP_NAME_MIN) | (F.length(n) > GROUP_NAME_MAX), "group_name length"),
        (c.isNotNull() & (F.length(c) != GROUP_CODE_LEN), "group_code length"),
    )
