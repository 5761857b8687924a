"""Whole analyses with the parsed input materialised once.

Each analysis reads its parsed table from several branches (pairing, per-job
statistics, global figures, reports). Parsing is the costly step (regular
expressions over every line), so these entry points parse once, write the
result to the cluster's checkpoint folder (a reliable checkpoint, which also
cuts lineage so a lost executor does not trigger a re-parse), and let every
branch read that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sheaf.functions.convlog import parse_convlog
from sheaf.functions.memlog import parse_memlog
from sheaf.operators import conversions as cv
from sheaf.operators import leaks
from sheaf.plans import reports
from sheaf.session import cut_lineage


@dataclass
class LeakAnalysis:
    entries: DataFrame
    container_limit_mb: float | None = None
    growth_rate_threshold: float = leaks.GROWTH_RATE_THRESHOLD
    baseline_shift_threshold: float = leaks.BASELINE_SHIFT_THRESHOLD
    avg_delta_threshold: float = leaks.AVG_DELTA_THRESHOLD
    bucket_seconds: int = 3600

    @classmethod
    def from_lines(cls, lines: DataFrame, lenient: bool = False, **kw) -> "LeakAnalysis":
        return cls(cut_lineage(parse_memlog(lines, lenient=lenient)), **kw)

    def orphans(self) -> DataFrame:
        return leaks.orphaned_jobs(self.entries, self.bucket_seconds)

    def job_stats(self) -> DataFrame:
        return leaks.job_stats(self.entries, container_limit_mb=self.container_limit_mb,
                               growth_rate_threshold=self.growth_rate_threshold,
                               baseline_shift_threshold=self.baseline_shift_threshold,
                               avg_delta_threshold=self.avg_delta_threshold, bucket_seconds=self.bucket_seconds)

    def top_culprits(self, n: int = leaks.TOP_N) -> DataFrame:
        return leaks.top_culprits(self.job_stats(), n)

    def overview(self) -> DataFrame:
        return leaks.analysis_overview(self.entries, container_limit_mb=self.container_limit_mb,
                                       bucket_seconds=self.bucket_seconds)

    def csv_lines(self) -> DataFrame:
        return reports.leak_csv_lines(leaks.top_culprits(self.job_stats(), hide_below=None))

    def report_lines(self) -> DataFrame:
        return reports.leak_report_lines(self.entries, container_limit_mb=self.container_limit_mb)


@dataclass
class ConversionAnalysis:
    events: DataFrame

    @classmethod
    def from_lines(cls, lines: DataFrame, lenient: bool = False) -> "ConversionAnalysis":
        return cls(cut_lineage(parse_convlog(lines, lenient=lenient)))

    def records(self) -> DataFrame:
        return cv.conversion_records(self.events)

    def csv_lines(self) -> DataFrame:
        return reports.conv_csv_lines(self.records())

    def report_lines(self) -> DataFrame:
        return reports.conv_report_lines(self.records())
