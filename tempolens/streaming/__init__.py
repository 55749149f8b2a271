"""Structured Streaming forms of the operators."""

from .operators import (end_marker, stream_counter_delta, stream_counter_delta_stateful, stream_load_timeline,  # noqa: F401
                        stream_long_transactions,
                        stream_sla_breaches, stream_usage_counts)
from .runner import ROCKSDB, deliver, latest_versions, run_available_now, scratch_dir, stage_files  # noqa: F401
