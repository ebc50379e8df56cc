"""The named queries once more as SQL for DuckDB, over the star-schema views.

Each statement states the rules directly (row-level windows, no skew handling),
so that it checks the DataFrame operators instead of repeating their steps.
"""

from rxcover.sources.star_schema import AS_OF, DAYS_IN_WINDOW, WINDOW

START, END = WINDOW
IN_WINDOW = f"drug_exposure_start_date BETWEEN DATE '{START}' AND DATE '{END}'"
# Fixed values (must equal the established rules): drug types, status, severity and bin labels, and the limits in the
# statements below, stated once more instead of being taken from schema.py.
DISPENSED = "drug_type_concept_id IN (38000175, 38000176, 581373)"


def _fold(day: str) -> str:
    days = f"date_diff('day', DATE '1995-01-01', CAST({day} AS DATE)) % {DAYS_IN_WINDOW}"
    return f"(DATE '{START}' + CAST({days} AS INTEGER))"


# The derived CDM tables.
CDM = {
    "drug_exposure": f"""
        SELECT l_orderkey * 8 + l_linenumber AS drug_exposure_id,
               o_custkey AS person_id,
               CASE WHEN l_orderkey < 5 THEN 8 WHEN l_orderkey < 35 THEN 9 ELSE l_partkey % 8 END AS drug_concept_id,
               CASE WHEN l_linenumber <> 7 OR l_suppkey % 9 <> 8 THEN {_fold("l_shipdate")} END
                 AS drug_exposure_start_date,
               CASE WHEN l_linenumber = 1 AND (l_partkey % 16 = 3 OR o_custkey % 10 = 4)
                    THEN {_fold("l_shipdate")} - CAST(2 + l_partkey % 3 AS INTEGER)
                    WHEN l_linenumber = 1
                    THEN {_fold("l_shipdate")} + CAST(l_quantity * 4 - 1 AS INTEGER) END AS drug_exposure_end_date,
               CASE WHEN l_partkey % 8 = 5 THEN NULL
                    WHEN l_linenumber IN (2, 3) THEN 30 * (1 + l_suppkey % 4)
                    WHEN l_linenumber = 4 THEN 0 END AS days_supply,
               CASE WHEN l_linenumber IN (4, 5) THEN l_suppkey % 5 END AS refills,
               l_quantity AS quantity,
               CASE WHEN l_returnflag = 'A' THEN 38000175 WHEN l_returnflag = 'N' THEN 38000176
                    WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 581373
                    ELSE 38000180 END::BIGINT AS drug_type_concept_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "concept": """
        SELECT CASE WHEN p_partkey % 10 = 7 THEN 70 ELSE p_partkey % 10 END AS concept_id,
               CASE WHEN p_partkey % 10 <> 4 THEN arg_min(p_name, p_partkey) END AS concept_name,
               arg_min(p_type, p_partkey) AS concept_class_id,
               CASE WHEN p_partkey % 10 = 6 THEN 'Device' ELSE 'Drug' END AS domain_id
        FROM part GROUP BY p_partkey % 10
        UNION ALL
        SELECT CASE WHEN n_nationkey < 6 THEN 1000 ELSE 2000 END + n_nationkey,
               CASE WHEN n_nationkey <> 2 THEN n_name END, 'Clinical Finding',
               CASE WHEN n_nationkey = 5 THEN 'Observation' ELSE 'Condition' END
        FROM nation""",
    "person": """
        SELECT CASE WHEN c_custkey % 40 = 39 THEN -c_custkey ELSE c_custkey END AS person_id,
               1930 + c_custkey % 70 AS year_of_birth
        FROM customer""",
    "condition_occurrence": f"""
        SELECT o_custkey AS person_id, 1000 + o_orderkey % 7 AS condition_concept_id,
               {_fold("o_orderdate")} AS condition_start_date
        FROM orders""",
}


def _ladder(end: str, supply: str, refills: str, default: str, median: str | None = None) -> str:
    rung = f"WHEN median_days_supply IS NOT NULL THEN {median}" if median else ""
    return f"""CASE WHEN drug_exposure_end_date IS NOT NULL THEN {end}
                    WHEN days_supply > 0 THEN {supply}
                    WHEN refills > 0 THEN {refills}
                    {rung} ELSE {default} END"""


START_COLUMN = "drug_exposure_start_date"


def _end_date(median: bool = False) -> str:
    def plus(days: str) -> str:
        return f"{START_COLUMN} + CAST({days} - 1 AS INTEGER)"

    return _ladder(
        "drug_exposure_end_date",
        plus("days_supply"),
        plus("refills * 30"),
        plus("30"),
        plus("floor(median_days_supply)") if median else None,
    )


def _days_covered(median: bool = False) -> str:
    recorded = f"date_diff('day', {START_COLUMN}, drug_exposure_end_date) + 1"
    return _ladder(recorded, "days_supply", "refills * 30", "30", "median_days_supply" if median else None)


MEDIANS = """
    SELECT drug_concept_id, CAST(median(days_supply) AS DOUBLE) AS median_days_supply
    FROM drug_exposure WHERE days_supply > 0 GROUP BY drug_concept_id"""


def _fills(where: str = "TRUE") -> str:
    return f"""
        SELECT *, {START_COLUMN} AS start_date, {_end_date()} AS end_date
        FROM drug_exposure WHERE {IN_WINDOW} AND {where}"""


IMPUTED_FILLS = f"""
    SELECT *, {START_COLUMN} AS start_date, {_end_date(median=True)} AS end_date
    FROM drug_exposure LEFT JOIN medians USING (drug_concept_id) WHERE {IN_WINDOW}"""

GROUPED = """
    SELECT *, sum(CASE WHEN start_date <= covered_until + 1 THEN 0 ELSE 1 END) OVER (
               PARTITION BY person_id, drug_concept_id ORDER BY start_date, end_date, drug_exposure_id
               ROWS UNBOUNDED PRECEDING) AS coverage_group
    FROM (SELECT *, max(end_date) OVER (
               PARTITION BY person_id, drug_concept_id ORDER BY start_date, end_date, drug_exposure_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_until FROM fills)"""

PERIODS = """
    SELECT person_id, drug_concept_id, CAST(coverage_group AS BIGINT) AS coverage_group,
           min(start_date) AS period_start, max(end_date) AS period_end, count(*) AS num_fills,
           date_diff('day', min(start_date), max(end_date)) + 1 AS days_covered
    FROM grouped GROUP BY person_id, drug_concept_id, coverage_group"""

PERIOD_GAPS = """
    SELECT *, coalesce(date_diff('day', period_end, next_period_start) - 1, 0) AS gap_days
    FROM (SELECT *, lead(period_start) OVER (PARTITION BY person_id, drug_concept_id ORDER BY coverage_group)
                 AS next_period_start FROM periods)"""

def _lagged(median: bool = False) -> str:
    known = "WHEN median_days_supply IS NOT NULL THEN median_days_supply" if median else ""
    supply = f"CASE WHEN days_supply > 0 THEN days_supply WHEN refills > 0 THEN refills * 30 {known} ELSE 30 END"
    return LAGGED.replace("{EFFECTIVE_SUPPLY}", supply)


LAGGED = """
    SELECT *, CASE WHEN start_date > prev_end_date THEN date_diff('day', prev_end_date, start_date) - 1 ELSE 0 END
                 AS gap_days,
           CASE WHEN start_date <= prev_end_date THEN date_diff('day', start_date, prev_end_date) ELSE 0 END
                 AS overlap_days,
           CASE WHEN start_date <= prev_end_date THEN greatest(0, date_diff('day', prev_end_date, end_date))
                ELSE date_diff('day', start_date, end_date) + 1 END AS adjusted_days_covered
    FROM (SELECT *, lag(end_date) OVER w AS prev_end_date, row_number() OVER w AS fill_number
          FROM (SELECT *, {EFFECTIVE_SUPPLY} AS effective_supply FROM fills)
          WINDOW w AS (PARTITION BY person_id, drug_concept_id
                       ORDER BY start_date, end_date, drug_exposure_id, effective_supply))"""

TOTAL_COLUMNS = """
    sum(CASE WHEN gap_days > 0 THEN 1 ELSE 0 END)::BIGINT AS num_gaps,
    sum(gap_days)::BIGINT AS total_gap_days, max(gap_days) AS max_gap_days"""

MERGE_TOTALS = f"""
    SELECT person_id, drug_concept_id, sum(days_covered)::BIGINT AS total_days_covered,
           date_diff('day', min(period_start), max(period_end)) + 1 AS treatment_duration,
           sum(num_fills)::BIGINT AS total_fills, count(*) AS num_periods, {TOTAL_COLUMNS},
           min(period_start) AS first_exposure_date, max(period_end) AS last_exposure_date
    FROM period_gaps GROUP BY person_id, drug_concept_id"""

LAG_TOTALS = f"""
    SELECT person_id, drug_concept_id, sum(adjusted_days_covered)::BIGINT AS total_days_covered,
           date_diff('day', min(start_date), max(end_date)) + 1 AS treatment_duration,
           count(*) AS total_fills, {TOTAL_COLUMNS},
           min(start_date) AS first_exposure_date, max(end_date) AS last_exposure_date
    FROM lagged GROUP BY person_id, drug_concept_id"""

# Rounding in whole ten-thousandths, halves away from 0.
SCORED = """
    SELECT *, units / 10000.0::DOUBLE AS pdc,
           CASE WHEN units >= 8000 THEN 'Adherent' WHEN units >= 7000 THEN 'Moderately Adherent'
                ELSE 'Non-Adherent' END AS adherence_status
    FROM (SELECT *, sign(total_days_covered) * ((2 * abs(total_days_covered) * 10000 + treatment_duration)
                                               // (2 * treatment_duration)) AS units
          FROM totals WHERE treatment_duration >= 30)"""

NAMED = """
    SELECT scored.*, concept_name AS drug_name, concept_class_id
    FROM scored LEFT JOIN concept ON drug_concept_id = concept_id"""

GAPS = """
    SELECT person_id, drug_concept_id, concept_name AS drug_name, fill_sequence,
           start_date AS fill_before_gap_date, end_date AS fill_before_gap_end_date,
           end_date + 1 AS gap_start_date, next_start_date - 1 AS gap_end_date, gap_days,
           CASE WHEN gap_days >= 90 THEN 'Critical Gap (90+ days)' WHEN gap_days >= 30 THEN 'Major Gap (30-89 days)'
                WHEN gap_days >= 14 THEN 'Moderate Gap (14-29 days)' WHEN gap_days >= 7 THEN 'Minor Gap (7-13 days)'
                ELSE 'Minimal Gap (<7 days)' END AS gap_severity,
           next_start_date AS fill_after_gap_date, days_supply AS days_supply_before_gap,
           quantity AS quantity_before_gap, drug_exposure_id AS fill_before_gap_id,
           next_exposure_id AS fill_after_gap_id
    FROM measured LEFT JOIN concept ON drug_concept_id = concept_id"""


def _measured(clamp: bool) -> str:
    signed = "date_diff('day', end_date, next_start_date) - 1"
    gap = f"CASE WHEN next_start_date > end_date THEN {signed} ELSE 0 END" if clamp else signed
    return f"""
        SELECT *, {gap} AS gap_days
        FROM (SELECT *, lead(start_date) OVER w AS next_start_date, lead(drug_exposure_id) OVER w AS next_exposure_id,
                     row_number() OVER w AS fill_sequence FROM fills
              WINDOW w AS (PARTITION BY person_id, drug_concept_id
                           ORDER BY start_date, drug_exposure_id, end_date, days_supply NULLS FIRST, quantity))"""


CONDITION_COUNTS = f"""
    SELECT person_id, condition_concept_id, concept_name, count(*) AS occurrence_count
    FROM condition_occurrence JOIN concept ON condition_concept_id = concept_id
    WHERE domain_id = 'Condition' AND concept_name IS NOT NULL AND condition_start_date <= DATE '{END}'
    GROUP BY person_id, condition_concept_id, concept_name"""

CONDITION_SUMMARY = """
    SELECT person_id, count(*) AS total_conditions, min(concept_name) FILTER (rn = 1) AS primary_condition_name
    FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY occurrence_count DESC, condition_concept_id)
                 AS rn FROM condition_counts)
    GROUP BY person_id"""


def _with(select: str, **steps: str) -> str:
    """`select` after the CDM tables and the given steps, as one WITH statement."""
    parts = [f"{name} AS ({body})" for name, body in {**CDM, **steps}.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


def _merge(select: str, where: str = DISPENSED) -> str:
    return _with(
        select,
        fills=_fills(where),
        grouped=GROUPED,
        periods=PERIODS,
        period_gaps=PERIOD_GAPS,
        totals=MERGE_TOTALS,
        scored=SCORED,
        pdc=NAMED,
    )


def _over_time(select: str, unit: str) -> str:
    """`cells`: every covered and every observed day of a patient-drug, counted by calendar unit."""
    return _with(
        select,
        fills=_fills(DISPENSED),
        grouped=GROUPED,
        periods=PERIODS,
        treated="""
            SELECT person_id, drug_concept_id, min(period_start) AS first_day, max(period_end) AS last_day
            FROM periods GROUP BY ALL HAVING date_diff('day', min(period_start), max(period_end)) + 1 >= 30""",
        counted=f"""
            SELECT person_id, drug_concept_id, CAST(date_trunc('{unit}', day) AS DATE) AS period, 1 AS covered, 0 AS observed
            FROM (SELECT person_id, drug_concept_id, unnest(generate_series(period_start, period_end, INTERVAL 1 DAY)) AS day
                  FROM periods WHERE period_end >= period_start)
            UNION ALL
            SELECT person_id, drug_concept_id, CAST(date_trunc('{unit}', period_start) AS DATE), days_covered, 0
            FROM periods WHERE period_end < period_start
            UNION ALL
            SELECT person_id, drug_concept_id, CAST(date_trunc('{unit}', day) AS DATE), 0, 1
            FROM (SELECT person_id, drug_concept_id, unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS day
                  FROM treated)""",
        cells="""
            SELECT *, units / 10000.0::DOUBLE AS pdc,
                   CASE WHEN units >= 8000 THEN 'Adherent' WHEN units >= 7000 THEN 'Moderately Adherent'
                        ELSE 'Non-Adherent' END AS adherence_status
            FROM (SELECT *, CASE WHEN observed_days > 0 THEN sign(covered_days)
                            * ((2 * abs(covered_days) * 10000 + observed_days) // (2 * observed_days)) ELSE 0 END AS units
                  FROM (SELECT person_id, drug_concept_id, period, sum(covered)::BIGINT AS covered_days,
                               sum(observed)::BIGINT AS observed_days
                        FROM counted SEMI JOIN treated USING (person_id, drug_concept_id) GROUP BY ALL)
                  WHERE observed_days > 0 OR covered_days <> 0)""",
        named="""
            SELECT cells.*, concept_name AS drug_name, concept_class_id
            FROM cells LEFT JOIN concept ON drug_concept_id = concept_id""",
    )


CELL_COLUMNS = """person_id, drug_concept_id, drug_name, concept_class_id, period, covered_days, observed_days, pdc,
    adherence_status"""


def _trend(unit: str, by: str | None = None) -> str:
    keys = f"{by}, period" if by else "period"
    return _over_time(
        f"""SELECT *, round(pooled_pdc - lag(pooled_pdc) OVER ({f"PARTITION BY {by}" if by else ""} ORDER BY period), 4) AS change
            FROM (SELECT {keys}, count(DISTINCT person_id) AS patients, count(*) AS combinations,
                         sum(covered_days)::BIGINT AS covered_days, sum(observed_days)::BIGINT AS observed_days,
                         {_half_up("sum(covered_days)", "sum(observed_days)", 4)} AS pooled_pdc,
                         {MEAN_PDC} AS mean_pdc, {PCT_ADHERENT} AS pct_adherent
                  FROM named {f"WHERE {by} IS NOT NULL" if by else ""} GROUP BY {keys})""",
        unit,
    )


def _gap_query(select: str, where: str = "TRUE", clamp: bool = False, min_gap: int = 7) -> str:
    gaps = f"SELECT * FROM ({GAPS}) WHERE gap_days >= {min_gap}"
    return _with(select, fills=_fills(where), measured=_measured(clamp), gaps=gaps)


def _half_up(number: str, per: str, places: int) -> str:
    """number / per of two non-negative integers, half-up."""
    scale = 10**places
    return f"CAST((2 * ({number}) * {scale} + ({per})) // (2 * nullif({per}, 0)) AS DOUBLE) / {scale}"


PDC_COLUMNS = """person_id, drug_concept_id, drug_name, concept_class_id, pdc, adherence_status, total_days_covered,
    treatment_duration, total_fills, num_periods, num_gaps, total_gap_days, max_gap_days, first_exposure_date,
    last_exposure_date"""
LAG_COLUMNS = PDC_COLUMNS.replace("num_periods, ", "")
GAP_COLUMNS = """person_id, drug_concept_id, drug_name, fill_sequence, fill_before_gap_date, fill_before_gap_end_date,
    gap_start_date, gap_end_date, gap_days, gap_severity, fill_after_gap_date, days_supply_before_gap"""
EXPOSURE_COLUMNS = """person_id, drug_concept_id, drug_exposure_id, drug_exposure_start_date AS start_date,
    drug_exposure_end_date, days_supply, refills, quantity, drug_type_concept_id"""

ADHERENT = "count(*) FILTER (adherence_status = 'Adherent')"
MEAN_PDC = "sum(units)::DOUBLE / (count(*) * 10000)::DOUBLE"
MEDIAN_PDC = "quantile_cont(units, 0.5) / 10000.0::DOUBLE"
PCT_ADHERENT = f"({ADHERENT} * 100)::DOUBLE / nullif(count(*), 0)::DOUBLE"


def _mean(column: str) -> str:
    return f"sum({column})::DOUBLE / nullif(count(*), 0)::DOUBLE"


DRUG_SUMMARY = f"""
    SELECT drug_name, count(DISTINCT person_id) AS unique_patients,
           {_half_up("sum(units)", "count(*) * 10000", 3)} AS mean_pdc,
           {_half_up("CAST(quantile_cont(units, 0.5) * 2 AS BIGINT)", "20000", 3)} AS median_pdc,
           round(stddev_samp(pdc), 3) AS std_pdc,
           {_half_up(f"{ADHERENT} * 100", "count(*)", 3)} AS pct_adherent,
           {_half_up("sum(num_gaps)", "count(*)", 3)} AS avg_gaps,
           {_half_up("sum(total_gap_days)", "count(*)", 3)} AS avg_gap_days,
           max(max_gap_days) AS max_gap
    FROM pdc WHERE drug_name IS NOT NULL GROUP BY drug_name"""

GAP_BY_DRUG = f"""
    SELECT drug_name, count(DISTINCT person_id) AS unique_patients, count(*) AS total_gaps,
           {_half_up("sum(gap_days)", "count(*)", 2)} AS avg_gap_days,
           quantile_cont(gap_days, 0.5)::DOUBLE AS median_gap_days, max(gap_days) AS max_gap_days,
           count(*) FILTER (contains(gap_severity, 'Critical')) AS critical_gaps
    FROM gaps WHERE drug_name IS NOT NULL GROUP BY drug_name"""

REPORT_MEASURES = f"""
    count(DISTINCT person_id) AS unique_patients, count(*) AS total_patient_drug_combinations,
    {ADHERENT} AS adherent_count,
    count(*) FILTER (adherence_status = 'Moderately Adherent') AS moderately_adherent_count,
    count(*) FILTER (adherence_status = 'Non-Adherent') AS non_adherent_count,
    {_half_up(f"{ADHERENT} * 100", "count(*)", 2)} AS pct_adherent,
    {_half_up("sum(units)", "count(*) * 10000", 4)} AS avg_pdc,
    min(pdc) AS min_pdc, max(pdc) AS max_pdc, round(stddev_samp(pdc), 4) AS stddev_pdc,
    {_half_up("sum(num_gaps)", "count(*)", 2)} AS avg_gaps_per_patient,
    {_half_up("sum(total_gap_days)", "count(*)", 2)} AS avg_gap_days_per_patient,
    max(total_gap_days) AS max_total_gap_days"""

# The measures that the distribution rows do not have.
NO_COUNTS = "adherent_count moderately_adherent_count non_adherent_count max_total_gap_days".split()
NO_MEANS = "pct_adherent avg_pdc min_pdc max_pdc stddev_pdc avg_gaps_per_patient avg_gap_days_per_patient".split()
ZERO_MEASURES = ", ".join([f"0 AS {c}" for c in NO_COUNTS] + [f"0.0 AS {c}" for c in NO_MEANS])

SUMMARY_REPORT = f"""
    SELECT 'Overall' AS category, 'All Drugs' AS subcategory, {REPORT_MEASURES} FROM pdc
    UNION ALL BY NAME
    SELECT 'By Drug' AS category, drug_name AS subcategory, {REPORT_MEASURES} FROM pdc
    GROUP BY drug_name HAVING count(DISTINCT person_id) >= 10
    UNION ALL BY NAME
    SELECT 'PDC Distribution' AS category,
           CASE WHEN units >= 9000 THEN '90-100%' WHEN units >= 8000 THEN '80-89%' WHEN units >= 7000 THEN '70-79%'
                WHEN units >= 6000 THEN '60-69%' WHEN units >= 5000 THEN '50-59%' ELSE '<50%' END AS subcategory,
           count(DISTINCT person_id) AS unique_patients, count(*) AS total_patient_drug_combinations, {ZERO_MEASURES}
    FROM pdc GROUP BY subcategory"""

HISTOGRAM = """
    SELECT b.bin, (low * 50 + b.bin * (high - low))::DOUBLE / 500000 AS lower_edge,
           (low * 50 + (b.bin + 1) * (high - low))::DOUBLE / 500000 AS upper_edge,
           count(units) AS combinations
    FROM (SELECT unnest(range(50)) AS bin) b
    JOIN (SELECT min(units) AS low, max(units) AS high FROM pdc) r ON TRUE
    LEFT JOIN pdc ON least(49, (units - low) * 50 // (high - low)) = b.bin
    GROUP BY b.bin, low, high"""


def _describe(column: str) -> str:
    return f"""
        SELECT '{column}' AS column_name, count({column}) AS count, sum({column})::DOUBLE / count({column}) AS mean,
               sqrt(greatest(0, (sum({column}::HUGEINT * {column})::DOUBLE - sum({column})::DOUBLE * sum({column})::DOUBLE
                                 / count({column})::DOUBLE) / (count({column})::DOUBLE - 1))) AS std, min({column})::DOUBLE AS min,
               quantile_cont({column}, 0.25)::DOUBLE AS q25, quantile_cont({column}, 0.5)::DOUBLE AS q50,
               quantile_cont({column}, 0.75)::DOUBLE AS q75, max({column})::DOUBLE AS max
        FROM listing"""


EXPOSURES = f"""
    SELECT {EXPOSURE_COLUMNS}, {_end_date()} AS calculated_end_date, {_days_covered()} AS days_covered
    FROM drug_exposure WHERE {IN_WINDOW}"""
LISTED_COLUMNS = (
    "person_id drug_concept_id drug_exposure_id start_date drug_exposure_end_date days_supply refills quantity "
    "drug_type_concept_id calculated_end_date days_covered"
).split()


def oracle_sql() -> dict[str, str]:
    return {
        "exposures_base": _with(EXPOSURES),
        "exposures_coverage": _with(
            f"""SELECT person_id, drug_concept_id, drug_exposure_id, {START_COLUMN} AS start_date,
                       {_end_date()} AS end_date, {_days_covered()} AS days_covered, days_supply, refills, quantity,
                       drug_type_concept_id
                FROM drug_exposure WHERE {IN_WINDOW} AND {DISPENSED}"""
        ),
        "exposures_imputed": _with(
            f"""SELECT {EXPOSURE_COLUMNS}, median_days_supply, {_end_date(median=True)} AS calculated_end_date,
                       CAST({_days_covered(median=True)} AS DOUBLE) AS days_covered,
                       {_ladder("'actual_end_date'", "'days_supply'", "'refills'", "'default_30'", "'drug_median'")}
                         AS imputation_method
                FROM drug_exposure LEFT JOIN medians USING (drug_concept_id) WHERE {IN_WINDOW}""",
            medians=MEDIANS,
        ),
        "drug_median_supply": _with(MEDIANS),
        "recent_exposures": _with(
            f"""SELECT * FROM drug_exposure
                WHERE drug_exposure_start_date BETWEEN DATE '{AS_OF}' - 180 AND DATE '{AS_OF}'"""
        ),
        "merged_periods": _merge("SELECT * FROM periods"),
        "coverage_gaps": _merge("SELECT * FROM period_gaps"),
        "pdc_by_month": _over_time(f"SELECT {CELL_COLUMNS} FROM named", "month"),
        "pdc_by_year": _over_time(f"SELECT {CELL_COLUMNS} FROM named", "year"),
        "trend_by_month": _trend("month"),
        "trend_by_drug": _trend("quarter", "drug_name"),
        "lag_fill_detail": _with(
            """SELECT person_id, drug_concept_id, drug_exposure_id, start_date, end_date,
                      effective_supply AS days_supply, fill_number, prev_end_date, gap_days, overlap_days, adjusted_days_covered FROM lagged""",
            fills=_fills(),
            lagged=_lagged(),
        ),
        "lag_fill_detail_imputed": _with(
            """SELECT person_id, drug_concept_id, drug_exposure_id, start_date, end_date,
                      CAST(effective_supply AS DOUBLE) AS days_supply, fill_number, prev_end_date, gap_days,
                      overlap_days, adjusted_days_covered FROM lagged""",
            medians=MEDIANS,
            fills=IMPUTED_FILLS,
            lagged=_lagged(median=True),
        ),
        "exposures_limited": _with(
            f"""SELECT * FROM ({EXPOSURES})
                ORDER BY person_id, drug_concept_id, start_date, drug_exposure_id, drug_exposure_end_date NULLS FIRST,
                         days_supply NULLS FIRST, refills NULLS FIRST, quantity, drug_type_concept_id,
                         calculated_end_date, days_covered LIMIT 1000"""
        ),
        "pdc_merge": _merge(f"SELECT {PDC_COLUMNS} FROM pdc"),
        "pdc_merge_ordered": _merge(
            """SELECT person_id, drug_concept_id, pdc, adherence_status,
                      row_number() OVER (ORDER BY person_id, drug_concept_id) AS position FROM pdc"""
        ),
        "pdc_export": _merge(f"SELECT {PDC_COLUMNS} FROM pdc"),
        "pdc_merge_all": _merge(f"SELECT {PDC_COLUMNS} FROM pdc", "TRUE"),
        "pdc_merge_avg_gap": _merge(
            f"""SELECT {PDC_COLUMNS}, CASE WHEN num_gaps > 0
                       THEN {_half_up("total_gap_days", "num_gaps", 4)} ELSE 0 END AS avg_gap_days FROM pdc"""
        ),
        "pdc_lag": _with(
            f"SELECT {LAG_COLUMNS} FROM pdc",
            fills=_fills(),
            lagged=_lagged(),
            totals=LAG_TOTALS,
            scored=SCORED,
            pdc=NAMED,
        ),
        "pdc_lag_enriched": _with(
            f"""SELECT {LAG_COLUMNS.replace("concept_name, ", "").replace(" pdc,", " greatest(least(pdc, 1.0), 0.0) AS pdc,")},
                       {AS_OF[:4]} - year_of_birth AS age,
                       coalesce(primary_condition_name, 'No Condition Recorded') AS primary_condition,
                       coalesce(total_conditions, 0) AS comorbidity_count
                FROM (SELECT scored.*, concept_name AS drug_name, concept_class_id
                      FROM scored JOIN concept ON drug_concept_id = concept_id
                      WHERE domain_id = 'Drug' AND concept_name IS NOT NULL)
                LEFT JOIN person USING (person_id) LEFT JOIN condition_summary USING (person_id)""",
            medians=MEDIANS,
            fills=IMPUTED_FILLS,
            lagged=_lagged(median=True),
            totals=LAG_TOTALS,
            scored=SCORED,
            condition_counts=CONDITION_COUNTS,
            condition_summary=CONDITION_SUMMARY,
        ),
        "gaps_detail": _gap_query(f"SELECT {GAP_COLUMNS} FROM gaps", DISPENSED),
        "gaps_detail_ordered": _gap_query(
            """SELECT person_id, drug_concept_id, fill_sequence, gap_days,
                      row_number() OVER (ORDER BY person_id, drug_concept_id, fill_sequence) AS position FROM gaps""",
            DISPENSED,
        ),
        "gaps_detail_full": _gap_query("SELECT * FROM gaps", DISPENSED),
        "gaps_detail_clamped": _gap_query(f"SELECT {GAP_COLUMNS} FROM gaps", clamp=True, min_gap=0),
        "gaps_detail_imputed": _with(
            f"SELECT {GAP_COLUMNS} FROM gaps",
            medians=MEDIANS,
            fills=IMPUTED_FILLS,
            measured=_measured(clamp=True),
            gaps=f"SELECT * FROM ({GAPS}) WHERE gap_days >= 7",
        ),
        "patient_age": _with(
            f"""SELECT person_id, {AS_OF[:4]} - year_of_birth AS age
                FROM (SELECT DISTINCT person_id FROM drug_exposure) LEFT JOIN person USING (person_id)"""
        ),
        "condition_counts": _with(CONDITION_COUNTS),
        "condition_summary": _with(CONDITION_SUMMARY, condition_counts=CONDITION_COUNTS),
        "summary_overall": _merge(
            f"""SELECT count(DISTINCT person_id) AS total_patients, count(*) AS total_patient_drug_combinations,
                       {ADHERENT} AS adherent_count, {PCT_ADHERENT} AS adherent_percentage, {MEAN_PDC} AS avg_pdc,
                       {MEDIAN_PDC} AS median_pdc, {_mean("num_gaps")} AS avg_gaps,
                       {_mean("total_gap_days")} AS avg_gap_days
                FROM pdc"""
        ),
        "summary_by_drug": _merge(
            f"""SELECT drug_name, count(DISTINCT person_id) AS unique_patients, {MEAN_PDC} AS mean_pdc,
                       {MEDIAN_PDC} AS median_pdc, round(stddev_samp(pdc), 6) AS std_pdc,
                       {PCT_ADHERENT} AS pct_adherent, {_mean("num_gaps")} AS avg_gaps,
                       {_mean("total_gap_days")} AS avg_gap_days
                FROM pdc WHERE drug_name IS NOT NULL GROUP BY drug_name"""
        ),
        "summary_distribution_cut": _merge(
            """SELECT pdc_bin, count(units) AS combinations
               FROM (VALUES ('<50%', 0, 5000), ('50-59%', 5000, 6000), ('60-69%', 6000, 7000),
                            ('70-79%', 7000, 8000), ('80-89%', 8000, 9000), ('90-100%', 9000, 10000))
                    AS bins(pdc_bin, above, upto)
               LEFT JOIN pdc ON units > above AND units <= upto GROUP BY pdc_bin"""
        ),
        "summary_report": _merge(SUMMARY_REPORT),
        "summary_report_ordered": _merge(
            f"""SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'Overall' THEN 1 WHEN 'By Drug' THEN 2 ELSE 3 END,
                                             subcategory NULLS FIRST) AS position
                FROM ({SUMMARY_REPORT})"""
        ),
        "notebook_overall": _merge(
            f"""SELECT *, total_combinations::DOUBLE / total_patients::DOUBLE AS avg_drugs_per_patient,
                       total_combinations - adherent_count AS non_adherent_count,
                       100 - adherent_pct AS non_adherent_pct
                FROM (SELECT count(DISTINCT person_id) AS total_patients, count(*) AS total_combinations,
                             {ADHERENT} AS adherent_count, {PCT_ADHERENT} AS adherent_pct, {MEAN_PDC} AS mean_pdc,
                             {MEDIAN_PDC} AS median_pdc, round(stddev_samp(pdc), 6) AS std_pdc, min(pdc) AS min_pdc,
                             max(pdc) AS max_pdc, {_mean("num_gaps")} AS avg_gaps,
                             {_mean("total_gap_days")} AS avg_gap_days, max(max_gap_days) AS max_gap_days FROM pdc)""",
            "TRUE",
        ),
        "status_distribution": _merge(
            """SELECT adherence_status, count(*) AS combinations,
                      (count(*) * 100)::DOUBLE / (SELECT count(*) FROM pdc)::DOUBLE AS percentage
               FROM pdc GROUP BY adherence_status""",
            "TRUE",
        ),
        "drug_summary": _merge(DRUG_SUMMARY, "TRUE"),
        "drug_summary_quick": _merge(
            f"""SELECT drug_name, unique_patients AS patients, mean_pdc, median_pdc, pct_adherent, avg_gaps
                FROM ({DRUG_SUMMARY})"""
        ),
        "pdc_histogram": _merge(HISTOGRAM, "TRUE"),
        "gap_by_drug": _gap_query(GAP_BY_DRUG),
        "gap_severity_distribution": _gap_query(
            "SELECT gap_severity, count(*) AS gaps FROM gaps GROUP BY gap_severity"
        ),
        "gap_totals": _gap_query(
            """SELECT count(*) AS gaps_found, count(DISTINCT person_id) AS patients_affected,
                      count(*) FILTER (gap_severity = 'Critical Gap (90+ days)') AS critical_gaps,
                      count(*) FILTER (gap_severity = 'Major Gap (30-89 days)') AS major_gaps FROM gaps"""
        ),
        "top_drugs": _merge(f"{DRUG_SUMMARY} ORDER BY unique_patients DESC, drug_name LIMIT 20", "TRUE"),
        "top_drugs_chart": _merge(
            f"""SELECT CASE WHEN length(drug_name) > 40 THEN drug_name[:40] || '...' ELSE drug_name END AS label,
                       unique_patients, mean_pdc, mean_pdc * 100 AS mean_pdc_pct, pct_adherent
                FROM ({DRUG_SUMMARY} ORDER BY unique_patients DESC, drug_name LIMIT 20)""",
            "TRUE",
        ),
        "low_adherence_drugs": _merge(
            f"""SELECT * FROM ({DRUG_SUMMARY}) WHERE unique_patients >= 50
                ORDER BY pct_adherent, drug_name LIMIT 10""",
            "TRUE",
        ),
        "lowest_adherence_lines": _merge(
            f"""SELECT drug_name[:50] AS drug_name, pct_adherent, mean_pdc
                FROM (SELECT * FROM ({DRUG_SUMMARY}) WHERE unique_patients >= 50
                      ORDER BY pct_adherent, drug_name LIMIT 5)""",
            "TRUE",
        ),
        "patients_chart": _merge(
            f"""SELECT drug_name, unique_patients FROM ({DRUG_SUMMARY})
                ORDER BY unique_patients DESC, drug_name LIMIT 10""",
            "TRUE",
        ),
        "top_gap_drugs": _gap_query(f"{GAP_BY_DRUG} ORDER BY total_gaps DESC, drug_name LIMIT 10"),
        "high_risk": _merge(
            """SELECT person_id, drug_concept_id, drug_name, pdc, max_gap_days, num_gaps FROM pdc
               WHERE adherence_status = 'Non-Adherent' AND max_gap_days >= 90
               ORDER BY max_gap_days DESC, person_id, drug_concept_id LIMIT 10"""
        ),
        "high_risk_patients": _merge(
            f"""SELECT {PDC_COLUMNS} FROM pdc WHERE adherence_status = 'Non-Adherent' AND max_gap_days >= 90"""
        ),
        "headline_report": _with(
            f"""SELECT * FROM (SELECT count(DISTINCT person_id) AS total_patients, count(*) AS total_combinations,
                                      {PCT_ADHERENT} AS adherence_rate, {MEAN_PDC} AS mean_pdc,
                                      {_mean("num_gaps")} AS avg_gaps FROM pdc)
                JOIN (SELECT count(*) AS gaps_found, count(DISTINCT person_id) AS patients_affected,
                             count(*) FILTER (gap_days >= 90) AS critical_gaps,
                             count(*) FILTER (gap_days BETWEEN 30 AND 89) AS major_gaps FROM gaps) ON TRUE""",
            fills=_fills(),
            grouped=GROUPED,
            periods=PERIODS,
            period_gaps=PERIOD_GAPS,
            totals=MERGE_TOTALS,
            scored=SCORED,
            pdc=NAMED,
            measured=_measured(clamp=False),
            gaps=f"SELECT * FROM ({GAPS}) WHERE gap_days >= 7",
        ),
        "database_info": _with(
            """SELECT count(*) AS total_drug_exposures, min(drug_exposure_start_date) AS min_date,
                      max(drug_exposure_start_date) AS max_date, count(DISTINCT person_id) AS unique_patients,
                      count(DISTINCT drug_concept_id) AS unique_drugs FROM drug_exposure"""
        ),
        "days_supply_null_stats": _with(
            f"""SELECT count(*) AS total, count(*) FILTER (days_supply IS NULL) AS null_count,
                       {_half_up("count(*) FILTER (days_supply IS NULL) * 100", "count(*)", 2)} AS pct_null
                FROM drug_exposure"""
        ),
        "actual_date_range": _with(
            """SELECT CAST(min(drug_exposure_start_date) AS VARCHAR) AS start_date,
                      CAST(max(drug_exposure_start_date) AS VARCHAR) AS end_date, count(*) AS total_records
               FROM drug_exposure"""
        ),
        "drug_type_counts": _with(
            """SELECT drug_type_concept_id, count(*) AS record_count FROM drug_exposure
               GROUP BY drug_type_concept_id ORDER BY record_count DESC, drug_type_concept_id LIMIT 20"""
        ),
        "null_profile": _with(
            """SELECT count(*) AS total_records, count(*) FILTER (drug_exposure_start_date IS NULL) AS null_start_dates,
                      count(*) FILTER (drug_exposure_end_date IS NULL) AS null_end_dates,
                      count(*) FILTER (days_supply IS NULL) AS null_days_supply,
                      count(*) FILTER (refills IS NULL) AS null_refills,
                      count(*) FILTER (days_supply IS NULL AND refills IS NULL AND drug_exposure_end_date IS NULL)
                        AS all_duration_fields_null
               FROM drug_exposure"""
        ),
        "column_null_counts": _with(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM listing"
                for c in LISTED_COLUMNS
            ),
            listing=EXPOSURES,
        ),
        "exposure_describe": _with(
            f"{_describe('days_supply')} UNION ALL {_describe('days_covered')}", listing=EXPOSURES
        ),
        "exposure_profile": _with(
            """SELECT count(*) AS rows, count(DISTINCT person_id) AS unique_patients,
                      count(DISTINCT drug_concept_id) AS unique_drugs, min(start_date) AS min_date,
                      max(start_date) AS max_date FROM listing""",
            listing=EXPOSURES,
        ),
        "latest_exposures": _with(
            "SELECT * FROM drug_exposure ORDER BY drug_exposure_start_date DESC, drug_exposure_id LIMIT 10"
        ),
        "zero_row_diagnosis": _with(
            f"""SELECT *, CASE WHEN records_in_window = 0 THEN 'no records in date range'
                               WHEN records_with_type = 0 THEN 'drug type filter excludes all records'
                               ELSE 'query should return rows' END AS verdict
                FROM (SELECT count(*) FILTER ({IN_WINDOW}) AS records_in_window,
                             count(*) FILTER ({IN_WINDOW} AND {DISPENSED}) AS records_with_type FROM drug_exposure)"""
        ),
        "reversed_dates": _with(
            """SELECT count(*) AS total,
                      count(*) FILTER (drug_exposure_end_date < drug_exposure_start_date) AS reversed_dates
               FROM drug_exposure"""
        ),
    }
