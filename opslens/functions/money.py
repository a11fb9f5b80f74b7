"""Money is DECIMAL; text forms round half to even at the printed digits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,9)"


def amount(text_or_number: Column) -> Column:
    """Any amount as DECIMAL; NULL if it is not a number."""
    return text_or_number.try_cast(MONEY)


def rounded(value: Column, places: int) -> Column:
    return F.bround(value.cast(MONEY), places)


def money_text(value: Column, places: int) -> Column:
    """Plain decimal text with exactly ``places`` digits after the point."""
    return rounded(value, places).cast(f"decimal(38,{places})").cast("string")
