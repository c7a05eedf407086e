"""Surface-grid quality and review engine built on PySpark DataFrames."""

from latticeqc.config import ReviewConfig
from latticeqc.plans.contract_report import contract_report, scan_report
from latticeqc.plans.folders import load_folder, read_folder, review_folder, scan_folder
from latticeqc.plans.full_review import full_review
from latticeqc.plans.geometry_report import geometry_report
from latticeqc.plans.perturbation import perturbation_benchmark
from latticeqc.plans.scoring import paired_report, threshold_selection
from latticeqc.plans.splits import isolated_split
from latticeqc.sources.surfaces import load_surface

__all__ = [
    "ReviewConfig",
    "contract_report",
    "full_review",
    "geometry_report",
    "isolated_split",
    "load_folder",
    "load_surface",
    "paired_report",
    "perturbation_benchmark",
    "read_folder",
    "review_folder",
    "scan_folder",
    "scan_report",
    "threshold_selection",
]
