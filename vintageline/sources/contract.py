"""Positional contract of the raw loan-month file.

A raw line has no header, so the position of a field is its identity. One table of names and
picture formats is kept here; logical type, text length, digit count and scale all follow from the
format: ``X(n)`` is text, ``9(n)`` an integer, ``9(n).99`` a decimal whose scale is the number of
nines after the point, ``MMYYYY`` a month.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import types as T

DELIMITER = "|"
SUPPORTED_WIDTHS = (108, 110, 113)
DEFAULT_WIDTH = 108

# Column names in file order with their picture format; a trailing '-' marks a
# field that single-family files leave unused.
FIELD_TABLE = """
POOL_ID X(4) -
LOAN_ID X(12)
ACT_PERIOD MMYYYY
CHANNEL X(1)
SELLER X(50)
SERVICER X(50)
MASTER_SERVICER X(10) -
ORIG_RATE 9(2).999
CURR_RATE 9(2).999
ORIG_UPB 9(10).99
ISSUANCE_UPB 9(10).99 -
CURRENT_UPB 9(10).99
ORIG_TERM 9(3)
ORIG_DATE MMYYYY
FIRST_PAY MMYYYY
LOAN_AGE 9(3)
REM_MONTHS 9(3)
ADJ_REM_MONTHS 9(3)
MATR_DT MMYYYY
OLTV 9(3)
OCLTV 9(3)
NUM_BO 9(2)
DTI 9(2)
CSCORE_B 9(3)
CSCORE_C 9(3)
FIRST_FLAG X(1)
PURPOSE X(1)
PROP X(2)
NO_UNITS 9(1)
OCC_STAT X(1)
STATE X(2)
MSA X(5)
ZIP X(3)
MI_PCT 9(3).99
PRODUCT X(3)
PPMT_FLG X(1)
IO X(1)
FIRST_PAY_IO MMYYYY
MNTHS_TO_AMTZ_IO 9(3)
DLQ_STATUS X(2)
PMT_HISTORY X(48)
MOD_FLAG X(1)
MI_CANCEL_FLAG X(2) -
ZERO_BAL_CODE X(3)
ZB_DTE MMYYYY
LAST_UPB 9(10).99
RPRCH_DTE MMYYYY -
CURR_SCHD_PRNCPL 9(10).99 -
TOT_SCHD_PRNCPL 9(10).99
UNSCHD_PRNCPL_CURR 9(10).99 -
LAST_PAID_INSTALLMENT_DATE MMYYYY
FORECLOSURE_DATE MMYYYY
DISPOSITION_DATE MMYYYY
FORECLOSURE_COSTS 9(10).99
PROPERTY_PRESERVATION_AND_REPAIR_COSTS 9(10).99
ASSET_RECOVERY_COSTS 9(10).99
MISCELLANEOUS_HOLDING_EXPENSES_AND_CREDITS 9(10).99
ASSOCIATED_TAXES_FOR_HOLDING_PROPERTY 9(10).99
NET_SALES_PROCEEDS 9(10).99
CREDIT_ENHANCEMENT_PROCEEDS 9(10).99
REPURCHASES_MAKE_WHOLE_PROCEEDS 9(10).99
OTHER_FORECLOSURE_PROCEEDS 9(10).99
NON_INTEREST_BEARING_UPB 9(10).99
PRINCIPAL_FORGIVENESS_AMOUNT 9(10).99
ORIGINAL_LIST_START_DATE MMYYYY -
ORIGINAL_LIST_PRICE 9(10).99 -
CURRENT_LIST_START_DATE MMYYYY -
CURRENT_LIST_PRICE 9(10).99 -
ISSUE_SCOREB 9(3) -
ISSUE_SCOREC 9(3) -
CURR_SCOREB 9(3) -
CURR_SCOREC 9(3) -
MI_TYPE X(1)
SERV_IND X(1)
CURRENT_PERIOD_MODIFICATION_LOSS_AMOUNT 9(10).99 -
CUMULATIVE_MODIFICATION_LOSS_AMOUNT 9(10).99 -
CURRENT_PERIOD_CREDIT_EVENT_NET_GAIN_OR_LOSS 9(10).99 -
CUMULATIVE_CREDIT_EVENT_NET_GAIN_OR_LOSS 9(10).99 -
HOMEREADY_PROGRAM_INDICATOR X(1)
FORECLOSURE_PRINCIPAL_WRITE_OFF_AMOUNT 9(10).99
RELOCATION_MORTGAGE_INDICATOR X(1)
ZERO_BALANCE_CODE_CHANGE_DATE MMYYYY -
LOAN_HOLDBACK_INDICATOR X(1) -
LOAN_HOLDBACK_EFFECTIVE_DATE MMYYYY -
DELINQUENT_ACCRUED_INTEREST 9(10).99 -
PROPERTY_INSPECTION_WAIVER_INDICATOR X(1)
HIGH_BALANCE_LOAN_INDICATOR X(1)
ARM_5_YR_INDICATOR X(1) -
ARM_PRODUCT_TYPE X(100) -
MONTHS_UNTIL_FIRST_PAYMENT_RESET 9(4) -
MONTHS_BETWEEN_SUBSEQUENT_PAYMENT_RESET 9(4) -
INTEREST_RATE_CHANGE_DATE MMYYYY -
PAYMENT_CHANGE_DATE MMYYYY -
ARM_INDEX X(100) -
ARM_CAP_STRUCTURE X(10) -
INITIAL_INTEREST_RATE_CAP 9(2).9999 -
PERIODIC_INTEREST_RATE_CAP 9(2).9999 -
LIFETIME_INTEREST_RATE_CAP 9(2).9999 -
MARGIN 9(2).9999 -
BALLOON_INDICATOR X(1) -
PLAN_NUMBER 9(4) -
FORBEARANCE_INDICATOR X(1)
HIGH_LOAN_TO_VALUE_HLTV_REFINANCE_OPTION_INDICATOR X(1)
DEAL_NAME X(200) -
RE_PROCS_FLAG X(1)
ADR_TYPE X(1)
ADR_COUNT 9(3)
ADR_UPB 9(10).99
PAYMENT_DEFERRAL_MOD_EVENT_FLAG X(1)
INTEREST_BEARING_UPB 9(10).99 -
ORIG_CLASSIC_FICO 9(3)
ISSUANCE_CLASSIC_FICO 9(3)
CURRENT_CLASSIC_FICO 9(3)
"""

# Positions the layout glossary announces but that no supported file width carries.
ANNOUNCED_POSITIONS = {114: "Origination VantageScore 4.0"}


class ContractError(ValueError):
    """A raw file or record does not satisfy the positional contract."""


@dataclass(frozen=True)
class Field:
    position: int
    name: str
    picture: str
    kind: str
    max_length: int | None
    digits: int | None
    scale: int
    applicable: bool

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "decimal":
            return T.DecimalType(20, self.scale)
        return {"string": T.StringType(), "integer": T.IntegerType(), "month": T.DateType()}[self.kind]


def _from_picture(position: int, line: str) -> Field:
    name, picture, *unused = line.split()
    text = re.fullmatch(r"X\((\d+)\)", picture)
    number = re.fullmatch(r"9\((\d+)\)(?:\.(9+))?", picture)
    length = digits = None
    scale = 0
    if text:
        kind, length = "string", int(text[1])
    elif number:
        kind, digits, scale = ("decimal" if number[2] else "integer"), int(number[1]), len(number[2] or "")
    else:
        kind = "month"
    return Field(position, name, picture, kind, length, digits, scale, not unused)


@lru_cache(maxsize=1)
def all_fields() -> tuple[Field, ...]:
    lines = FIELD_TABLE.strip().splitlines()
    return tuple(_from_picture(i, line) for i, line in enumerate(lines, start=1))


def fields_of_width(width: int = DEFAULT_WIDTH) -> tuple[Field, ...]:
    """The leading fields of a supported file width; any other width is refused."""
    if width not in SUPPORTED_WIDTHS:
        raise ContractError(f"file width {width} is not supported; known widths are {SUPPORTED_WIDTHS}")
    return all_fields()[:width]


def raw_schema(width: int = DEFAULT_WIDTH) -> T.StructType:
    """All-text schema of a raw file (SRC1)."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in fields_of_width(width)])
