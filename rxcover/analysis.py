"""The public interface: one analysis over a set of tables with a named set of rules."""

from dataclasses import dataclass
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame

from rxcover.operators import adherence, enrich, exposures, gaps, quality, report, summary, trends
from rxcover.schema import DAYS_PER_MONTH, MIN_GAP_DAYS, MIN_TREATMENT_DAYS, PDC_THRESHOLD
from rxcover.sources.cdm import CdmTables

Day = date | str


@dataclass(frozen=True)
class Profile:
    """Which of the established rule variants an analysis follows."""

    method: str = "merge"  # or "lag": adjust by the previous fill only
    dispensed_only: bool = False  # default of the drug type filter
    impute: bool = False  # use the drug's median supply before the default
    clamp_gaps: bool = False  # negative gaps count as 0
    cap_pdc: bool = False
    enriched: bool = False  # age, conditions, drugs of the drug domain only
    avg_gap: bool = False
    full_gaps: bool = False  # fill ids and quantity in the gap listing


PROFILES = {
    "dispensed": Profile(dispensed_only=True),
    "merge": Profile(),
    "lag": Profile(method="lag", clamp_gaps=True),
    "enriched": Profile(method="lag", impute=True, clamp_gaps=True, cap_pdc=True, enriched=True),
    "script": Profile(dispensed_only=True, avg_gap=True, full_gaps=True),
}


def get_date_range(months_back: int = 12, today: date | None = None) -> tuple[str, str]:
    """The last `months_back` months of 30 days as text."""
    end = today or date.today()
    return str(end - timedelta(days=DAYS_PER_MONTH * months_back)), str(end)


class AdherenceAnalysis:
    """Each method returns lazy DataFrames; building one starts no job."""

    def __init__(self, tables: CdmTables, profile: Profile | str = "merge"):
        self.tables = tables
        self.profile = PROFILES[profile] if isinstance(profile, str) else profile

    def get_adjusted_fills(self, start: Day, end: Day, filter_drug_type: bool | None = None) -> DataFrame:
        """Every fill with the previous fill's end and the days it adds beyond it."""
        return gaps.adjusted_fills(self._fills(start, end, filter_drug_type))

    def _fills(self, start: Day, end: Day, filter_drug_type: bool | None) -> DataFrame:
        dispensed_only = self.profile.dispensed_only if filter_drug_type is None else filter_drug_type
        return exposures.coverage_fills(self.tables.drug_exposure, start, end, dispensed_only, self.profile.impute)

    def get_drug_exposures(
        self, start: Day, end: Day, limit: int | None = None, filter_drug_type: bool | None = None
    ) -> DataFrame:
        dispensed_only = self.profile.dispensed_only if filter_drug_type is None else filter_drug_type
        return exposures.drug_exposures(
            self.tables.drug_exposure, start, end, dispensed_only, self.profile.impute, limit
        )

    def calculate_pdc(
        self,
        start: Day,
        end: Day,
        pdc_threshold: Decimal | float | str = PDC_THRESHOLD,
        min_treatment_days: int = MIN_TREATMENT_DAYS,
        filter_drug_type: bool | None = None,
        as_of: Day | None = None,
        keep_unmapped: bool = False,
    ) -> DataFrame:
        """PDC per patient and drug, with drug names."""
        profile, tables = self.profile, self.tables
        pdc = adherence.patient_drug_pdc(
            self._fills(start, end, filter_drug_type),
            profile.method,
            pdc_threshold,
            min_treatment_days,
            profile.cap_pdc,
            profile.avg_gap,
        )
        if not profile.enriched:
            return enrich.attach_drug_names(pdc, tables.concept)
        return enrich.enrich_pdc(
            pdc,
            tables.concept,
            tables.person,
            tables.condition_occurrence,
            until=end,
            as_of=as_of,
            keep_unmapped=keep_unmapped,
        )

    def get_detailed_gaps(
        self, start: Day, end: Day, min_gap_days: int = MIN_GAP_DAYS, filter_drug_type: bool | None = None
    ) -> DataFrame:
        """Gaps between consecutive fills, with drug names."""
        found = gaps.consecutive_gaps(
            self._fills(start, end, filter_drug_type), min_gap_days, self.profile.clamp_gaps, self.profile.full_gaps
        )
        return enrich.attach_drug_names(found, self.tables.concept, with_class=False)

    def get_gap_counts(
        self, start: Day, end: Day, min_gap_days: int = MIN_GAP_DAYS, filter_drug_type: bool | None = None
    ) -> DataFrame:
        """The gaps of `get_detailed_gaps` counted per patient, drug and length, without a listing."""
        found = gaps.gap_counts(self._fills(start, end, filter_drug_type), min_gap_days, self.profile.clamp_gaps)
        return enrich.attach_drug_names(found, self.tables.concept, with_class=False)

    def get_adherence_over_time(
        self,
        start: Day,
        end: Day,
        unit: str = "month",
        pdc_threshold: Decimal | float | str = PDC_THRESHOLD,
        min_treatment_days: int = MIN_TREATMENT_DAYS,
        filter_drug_type: bool | None = None,
    ) -> DataFrame:
        """Covered and observed days and PDC per patient, drug and `month`, `quarter` or `year`, under merged coverage."""
        cells = trends.calendar_pdc(self._fills(start, end, filter_drug_type), unit, pdc_threshold, min_treatment_days)
        return enrich.attach_drug_names(cells, self.tables.concept)

    def get_headline(
        self,
        start: Day,
        end: Day,
        pdc_threshold: Decimal | float | str = PDC_THRESHOLD,
        min_treatment_days: int = MIN_TREATMENT_DAYS,
        min_gap_days: int = MIN_GAP_DAYS,
        filter_drug_type: bool | None = None,
    ) -> DataFrame:
        """One row of headline figures, under merged coverage and signed gaps."""
        fills = self._fills(start, end, filter_drug_type)
        return report.headline_of_fills(fills, pdc_threshold, min_treatment_days, min_gap_days)

    def get_summary_statistics(
        self, start: Day, end: Day, pdc_threshold: Decimal | float | str = PDC_THRESHOLD
    ) -> dict[str, DataFrame]:
        """Overall, per-drug and distribution frames over one kept PDC result (`full_data`).

        Call `result["full_data"].unpersist()` when done.
        """
        pdc = self.calculate_pdc(start, end, pdc_threshold).persist()
        return {
            "overall": summary.summary_overall(pdc),
            "by_drug": summary.summary_by_drug(pdc),
            "pdc_distribution": summary.pdc_distribution(pdc),
            "full_data": pdc,
        }

    def get_database_info(self) -> DataFrame:
        return quality.database_info(self.tables.drug_exposure)

    def get_days_supply_null_stats(self) -> DataFrame:
        return quality.days_supply_null_stats(self.tables.drug_exposure)

    def get_actual_date_range(self) -> DataFrame:
        return quality.actual_date_range(self.tables.drug_exposure)
