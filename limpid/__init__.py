"""Profile tables of unknown quality, clean them, and account for every change."""

from limpid.options import CleaningOptions, decide
from limpid.plans.audit import audit_summary, audit_table, control, run_stamp, step_totals
from limpid.plans.cleaning import CleaningPlan, CleaningResult, clean, fit_cleaning
from limpid.plans.profile import Profile, profile
from limpid.session import tune
from limpid.sources.reports import compared_runs, read_reports, write_reports
from limpid.sources.tables import load_table, load_with_losses, write_table

__all__ = [
    "CleaningOptions", "CleaningPlan", "CleaningResult", "Profile", "audit_summary",
    "audit_table", "clean", "compared_runs", "control", "decide", "fit_cleaning", "load_table",
    "load_with_losses", "profile",
    "read_reports", "run_stamp", "step_totals", "tune", "write_reports", "write_table",
]
