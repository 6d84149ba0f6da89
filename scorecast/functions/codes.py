"""Six-character group codes.

The reference draws random codes and retries until unused. A retry loop is a per-row
round trip; instead an affine bijection on [0, 36^6) maps every group id to a distinct
code, so a whole batch gets unique codes in one projection with no retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the code scheme. The multiplier is coprime to 36^6 = 2^12 * 3^12 (odd,
# digit sum 29), so id -> code is a bijection for ids in [0, 36^6), i.e. any INT id.
CODE_WIDTH = 6
CODE_SPACE = 36 ** CODE_WIDTH  # 2176782336
CODE_MULTIPLIER = 1103515247
CODE_INCREMENT = 12345
CODE_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def code_number(group_id, step: int = 0) -> Column:
    """The number of an id's code; ``step`` moves on to the next numbers. Six characters hold
    36^6 codes: an id outside that range has none (NULL) rather than another id's."""
    gid = (F.col(group_id) if isinstance(group_id, str) else group_id).cast("bigint")
    number = (gid * F.lit(CODE_MULTIPLIER) + F.lit(CODE_INCREMENT + step)) % F.lit(CODE_SPACE)
    return F.when((gid >= 0) & (gid < CODE_SPACE), number)


def group_code(group_id, step: int = 0) -> Column:
    """Base-36, zero-padded to six characters, upper case; NULL beyond the code space."""
    return F.lpad(F.conv(code_number(group_id, step).cast("string"), 10, 36), CODE_WIDTH, "0")


def normalize_code(code) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.upper(F.trim(c))
