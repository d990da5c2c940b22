"""Spark-native search for leaked credentials in text corpora and file histories."""

from leaksieve.operators.detect import DetectOptions, match_rules
from leaksieve.plans.scan import Selection, scan, scan_files, scan_history, summary
from leaksieve.sources.catalog import (
    Allowlist,
    Rule,
    RuleSet,
    load_catalog,
    load_extended,
    parse_catalog,
    stock_rules,
)

__all__ = [
    "Allowlist",
    "DetectOptions",
    "Rule",
    "RuleSet",
    "Selection",
    "load_catalog",
    "load_extended",
    "match_rules",
    "parse_catalog",
    "scan",
    "scan_files",
    "scan_history",
    "stock_rules",
    "summary",
]
