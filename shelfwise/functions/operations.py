"""Classes and labels of operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operation codes that are a loan or a return.
LOAN_OPIDS = (4, 94, 97, 225)
RETURN_OPIDS = (5, 95, 98, 226)


def operation_flags(opid: Column) -> dict[str, Column]:
    is_loan = F.coalesce(opid.isin(*LOAN_OPIDS), F.lit(False))
    is_return = F.coalesce(opid.isin(*RETURN_OPIDS), F.lit(False))
    return {
        "IS_LOAN": is_loan,
        "IS_RETURN": is_return,
        "IS_RENEWAL": F.lit(False),
        "ACTION_GROUP": F.when(is_loan, "loan").when(is_return, "return").otherwise("other"),
    }


def action_type(description: Column, opid: Column) -> Column:
    """Description of the operation, or its code when there is none."""
    return F.when(F.trim(description) != "", description).otherwise(opid.cast("string"))


def decode(label: Column, code: Column) -> Column:
    return F.coalesce(label, code)
