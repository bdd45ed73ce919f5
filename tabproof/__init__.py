"""Prove on Spark that a changed pipeline still produces the same tables."""

from .operators.counts import partition_count_diff, partition_counts, row_counts
from .operators.fingerprint import compare_fingerprints, fingerprint_diff
from .operators.keydiff import changes_by_column, key_classes, key_diff, key_diff_summary
from .operators.multiset import multiset_diff, multiset_diff_rows
from .operators.schema import contract_diff, require_contract, schema_diff
from .plans.flow import compare_flows, flow_rollup, validate_flow, validate_replay
from .plans.ladder import NotEquivalent, Verdict, compare, require_equivalent
from .plans.promotion import PromotionBlocked, missing_steps, promotion_gate, promotion_outcome, require_promotable
from .sources.audit import AuditLog, scorecard
from .sources.registry import Registry, select_notebooks
from .sources.snapshots import SnapshotStore, sample_by_key

__all__ = [
    "AuditLog", "NotEquivalent", "PromotionBlocked", "Registry", "SnapshotStore", "Verdict",
    "changes_by_column", "compare", "compare_fingerprints", "compare_flows", "contract_diff",
    "fingerprint_diff", "flow_rollup", "key_classes", "key_diff", "key_diff_summary", "missing_steps",
    "multiset_diff", "multiset_diff_rows", "partition_count_diff", "partition_counts",
    "promotion_gate", "promotion_outcome", "require_contract", "require_equivalent",
    "require_promotable", "row_counts", "sample_by_key", "schema_diff", "scorecard",
    "select_notebooks", "validate_flow", "validate_replay",
]
