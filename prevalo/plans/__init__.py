"""Reports composed from the operators."""

from prevalo.plans.reports import (
    case_control_report,
    fixed_year_report,
    multi_code_report,
    single_code_report,
    tracer_report,
    write_report,
)
from prevalo.plans.settings import label_years, result_folder

__all__ = [
    "case_control_report",
    "fixed_year_report",
    "label_years",
    "multi_code_report",
    "result_folder",
    "single_code_report",
    "tracer_report",
    "write_report",
]
