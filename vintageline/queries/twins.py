"""DuckDB CTE fragments that restate the fixtures and operators for the SQL twins."""

PANEL = """
seed AS (
  SELECT c_custkey AS k, c_custkey % 6 AS q FROM customer WHERE c_custkey IS NOT NULL
),
loan0 AS (
  SELECT k, q,
    'SYN' || lpad(CAST(k AS VARCHAR), greatest(9, length(CAST(k AS VARCHAR)))::INT, '0') AS LOAN_ID,
    ['2005Q1','2005Q3','2007Q1','2012Q1','2016Q1','2018Q1'][CAST(q AS INT) + 1] AS quarter,
    55 + (k*37)%43 AS ltv, 18 + (k*53)%33 AS dti, 610 + (k*71)%201 AS fico,
    80000 + 5000*((k*17)%114) AS upb, [180,240,360][CAST(k%3 AS INT) + 1] AS term,
    16*((k*37)%43) + 16*((k*53)%33) + 3*(200-(k*71)%201) + (CASE WHEN q<3 THEN 700 ELSE 300 END) AS sc
  FROM seed
),
loan1 AS (
  SELECT *, make_date(CAST(quarter[1:4] AS INT), CAST(quarter[6:6] AS INT)*3 - 2, 1) AS d0,
    CASE WHEN k%29=0 THEN 'R' WHEN sc>1240 AND (k*13)%100<75 THEN 'D'
         WHEN sc<520 AND (k*13)%100<70 THEN 'P' ELSE 'C' END AS ev,
    CASE WHEN q=3 THEN 13+(k*19)%80 ELSE 13+(k*19)%20 END AS em,
    CASE WHEN q=3 THEN 96 ELSE 36 END AS mx
  FROM loan0
),
loan AS (
  SELECT *, CASE WHEN ev='D' THEN least(mx, em+3) WHEN ev IN ('P','R') THEN least(mx, em) ELSE mx END AS n
  FROM loan1
),
panel AS (
  SELECT LOAN_ID, CAST(d0 + to_months(CAST(i AS INT)) AS DATE) AS ACT_PERIOD,
    CAST(d0 - to_months(2) AS DATE) AS ORIG_DATE,
    CASE WHEN k%101=0 THEN 'Z' ELSE ['R','C','B'][CAST(k%3 AS INT)+1] END AS CHANNEL,
    'S' || CAST((k + i//14) % 5 AS VARCHAR) AS SERVICER,
    CAST((2750 + (k*97)%4501) AS DOUBLE)/1000 AS ORIG_RATE,
    CAST(upb AS DOUBLE) AS ORIG_UPB,
    CAST(upb AS DOUBLE) * (1 - CAST(i AS DOUBLE)/term) AS CURRENT_UPB,
    CAST(term AS INT) AS ORIG_TERM, CAST(i AS INT) AS LOAN_AGE, CAST(ltv AS INT) AS OLTV,
    CASE WHEN k%11=0 THEN NULL ELSE CAST(least(105, ltv + [0,0,5,10][CAST(k%4 AS INT)+1]) AS INT) END AS OCLTV,
    CAST(dti AS INT) AS DTI, CAST(fico AS INT) AS CSCORE_B,
    CASE WHEN k%2=0 THEN NULL ELSE CAST(620+(k*29)%201 AS INT) END AS CSCORE_C,
    ['P','R','C','U'][CAST(k%4 AS INT)+1] AS PURPOSE, ['SF','CO','PU','CP','MH'][CAST(k%5 AS INT)+1] AS PROP,
    ['P','S','I','U'][CAST((k//2)%4 AS INT)+1] AS OCC_STAT,
    ['CA','FL','GA','IL','NY','OH','TX','WA'][CAST(k%8 AS INT)+1] AS STATE,
    CASE WHEN ev='D' THEN (CASE WHEN i>=em-1 THEN '03' WHEN i=em-2 THEN '02' WHEN i=em-3 THEN '01' ELSE '00' END)
         WHEN k%97=0 AND i=5 THEN 'XX' ELSE '00' END AS DLQ_STATUS,
    CASE WHEN i=em-1 AND ev='P' THEN '01' WHEN i=em-1 AND ev='R' THEN '06' END AS ZERO_BAL_CODE,
    quarter || '.csv' AS _source_file
  FROM loan, LATERAL (SELECT unnest(range(n)) AS i) u
)"""

SURVIVAL = (
    PANEL
    + """,
marked AS (
  SELECT *,
    min(CASE WHEN regexp_full_match(DLQ_STATUS, '[0-9]+') AND TRY_CAST(DLQ_STATUS AS INT) >= 3 THEN ACT_PERIOD END)
      OVER (PARTITION BY LOAN_ID) AS raw_d,
    min(CASE WHEN trim(ZERO_BAL_CODE) <> '' THEN ACT_PERIOD END) OVER (PARTITION BY LOAN_ID) AS FIRST_CENSOR_DATE,
    min(CASE WHEN trim(ZERO_BAL_CODE) <> '' THEN strftime(ACT_PERIOD, '%Y-%m-%d') || trim(ZERO_BAL_CODE) END)
      OVER (PARTITION BY LOAN_ID) AS cc,
    max(ACT_PERIOD) OVER (PARTITION BY LOAN_ID) AS LAST_OBSERVED_DATE,
    count(*) OVER (PARTITION BY LOAN_ID) AS SOURCE_OBSERVED_MONTHS
  FROM panel
),
resolved AS (
  SELECT * EXCLUDE (raw_d, cc), cc[11:] AS FIRST_CENSOR_CODE,
    CASE WHEN FIRST_CENSOR_DATE IS NULL OR raw_d <= FIRST_CENSOR_DATE THEN raw_d END AS FIRST_D90_DATE
  FROM marked
),
exits AS (
  SELECT *, least(FIRST_D90_DATE, FIRST_CENSOR_DATE) AS EXIT_DATE,
    CASE WHEN FIRST_D90_DATE IS NOT NULL THEN 'default' WHEN FIRST_CENSOR_CODE='01' THEN 'prepaid'
         WHEN FIRST_CENSOR_CODE='06' THEN 'repurchased' WHEN FIRST_CENSOR_DATE IS NOT NULL THEN 'other_exit'
         ELSE 'right_censored' END AS EXIT_TYPE
  FROM resolved
),
surv AS (
  SELECT *, count(*) OVER (PARTITION BY LOAN_ID) AS AT_RISK_OBSERVED_MONTHS,
    CAST(row_number() OVER (PARTITION BY LOAN_ID ORDER BY ACT_PERIOD) AS INT) AS AT_RISK_MONTH_NUMBER
  FROM (
    SELECT *, CAST(ACT_PERIOD + to_months(12) AS DATE) AS HORIZON_END_DATE,
      CASE WHEN FIRST_D90_DATE = CAST(ACT_PERIOD + to_months(1) AS DATE) THEN 1
           WHEN least(LAST_OBSERVED_DATE, FIRST_CENSOR_DATE) >= CAST(ACT_PERIOD + to_months(1) AS DATE) THEN 0 END
        AS DEFAULT_NEXT_MONTH,
      CASE WHEN FIRST_D90_DATE > ACT_PERIOD AND FIRST_D90_DATE <= CAST(ACT_PERIOD + to_months(12) AS DATE) THEN 1
           WHEN least(LAST_OBSERVED_DATE, FIRST_CENSOR_DATE) >= CAST(ACT_PERIOD + to_months(12) AS DATE) THEN 0 END
        AS DEFAULT_IN_12M
    FROM exits WHERE EXIT_DATE IS NULL OR ACT_PERIOD < EXIT_DATE
  ) s0
)"""
)

SPLIT_COLUMNS = """
    upper(regexp_extract(_source_file, '^([0-9]{4}Q[1-4])', 1)) AS ACQUISITION_QUARTER,
    CASE WHEN ACT_PERIOD <= DATE '2015-12-01' THEN 'train' WHEN ACT_PERIOD <= DATE '2017-12-01' THEN 'validation'
         ELSE 'out_of_time' END AS TEMPORAL_SPLIT,
    _source_file IN ('2016Q1.csv','2018Q1.csv') AS IS_OUT_OF_VINTAGE,
    CASE WHEN _source_file IN ('2016Q1.csv','2018Q1.csv') THEN 'out_of_vintage'
         WHEN ACT_PERIOD <= DATE '2015-12-01' THEN 'train' WHEN ACT_PERIOD <= DATE '2017-12-01' THEN 'validation'
         ELSE 'out_of_time' END AS MODELLING_SPLIT"""

SPLIT = (
    SURVIVAL
    + f""",
splitp AS (SELECT *, {SPLIT_COLUMNS} FROM surv)"""
)

RELEASES = """
releases AS (
  SELECT SERIES_ID, obs AS OBSERVATION_DATE, CAST(obs + to_days(CAST(lag + 400*rv AS INT)) AS DATE) AS AVAILABLE_DATE,
    CAST(base + rv AS DECIMAL(20,6)) AS VALUE
  FROM (
    SELECT i, rv, CAST(DATE '2004-01-01' + to_months(CAST(i AS INT)) AS DATE) AS obs
    FROM range(204) t(i), (VALUES (0),(1)) r(rv) WHERE rv=0 OR i%6=0
  ) m,
  LATERAL (
    SELECT 'UNRATE' AS SERIES_ID, 34 AS lag, 4.0::DOUBLE + 0.01::DOUBLE*i AS base
    UNION ALL SELECT 'CSUSHPINSA', 60, 150.0::DOUBLE + 0.5::DOUBLE*i WHERE i>=72
    UNION ALL SELECT 'MORTGAGE30US', 0, 6.0::DOUBLE - 0.01::DOUBLE*i
  ) s
)"""


def _wide(name: str, dates: str, prefix: str, series: tuple) -> str:
    columns = ", ".join(
        f"arg_max(VALUE, {{'a': OBSERVATION_DATE, 'b': AVAILABLE_DATE}}) FILTER (SERIES_ID='{s}') AS {prefix}{s}, "
        f"max(OBSERVATION_DATE) FILTER (SERIES_ID='{s}') AS {prefix}{s}_OBSERVATION_DATE, "
        f"arg_max(AVAILABLE_DATE, {{'a': OBSERVATION_DATE, 'b': AVAILABLE_DATE}}) FILTER (SERIES_ID='{s}')"
        f" AS {prefix}{s}_AVAILABLE_DATE"
        for s in series
    )
    return f"""
{name} AS (
  SELECT aod, {columns}
  FROM (SELECT DISTINCT {dates} AS aod FROM panel) d JOIN releases r
    ON r.OBSERVATION_DATE <= d.aod AND r.AVAILABLE_DATE <= d.aod
  GROUP BY aod
)"""


MACRO_WIDE = (
    _wide("wide", "ACT_PERIOD", "", ("UNRATE", "CSUSHPINSA", "MORTGAGE30US"))
    + ","
    + _wide("wideo", "ORIG_DATE", "ORIG_", ("CSUSHPINSA",))
)

GOLD = (
    SPLIT
    + ","
    + RELEASES
    + ","
    + MACRO_WIDE
    + """,
featured AS (
  SELECT s.*,
    CAST((year(ACT_PERIOD)-year(ORIG_DATE))*12 + month(ACT_PERIOD)-month(ORIG_DATE) AS INT) AS SEASONING_MONTHS,
    least(CSCORE_B, CSCORE_C) AS CLASSIC_FICO,
    CASE WHEN OLTV > 0 THEN ORIG_UPB / (OLTV / 100.0::DOUBLE) END AS ORIGINAL_PROPERTY_VALUE,
    wide.* EXCLUDE (aod), wideo.* EXCLUDE (aod)
  FROM splitp s LEFT JOIN wide ON s.ACT_PERIOD = wide.aod LEFT JOIN wideo ON s.ORIG_DATE = wideo.aod
),
gold AS (
  SELECT *,
    CASE WHEN ORIGINAL_PROPERTY_VALUE > 0 THEN CURRENT_UPB / ORIGINAL_PROPERTY_VALUE * 100.0::DOUBLE END
      AS CURRENT_LTV_UNINDEXED,
    ORIGINAL_PROPERTY_VALUE * CAST(CSUSHPINSA AS DOUBLE) / CAST(ORIG_CSUSHPINSA AS DOUBLE)
      AS ESTIMATED_CURRENT_PROPERTY_VALUE,
    CASE WHEN ORIGINAL_PROPERTY_VALUE * CAST(CSUSHPINSA AS DOUBLE) / CAST(ORIG_CSUSHPINSA AS DOUBLE) > 0
      THEN CURRENT_UPB / (ORIGINAL_PROPERTY_VALUE * CAST(CSUSHPINSA AS DOUBLE) / CAST(ORIG_CSUSHPINSA AS DOUBLE))
           * 100.0::DOUBLE END AS CURRENT_LTV
  FROM featured
)"""
)


def with_panel(select: str) -> str:
    return f"WITH {PANEL}\n{select}"


def with_survival(select: str) -> str:
    return f"WITH {SURVIVAL}\n{select}"


def with_split(select: str) -> str:
    return f"WITH {SPLIT}\n{select}"


def with_gold(select: str) -> str:
    return f"WITH {GOLD}\n{select}"
