"""Process analytics on Spark: event logs in, leakage-free features, targets and splits out."""

from eventloom.eventlog import EventLog, case_ids, event_ids, timestamps, to_event_log, trace_positions
from eventloom.operators.split import train_test_split

__version__ = "0.1.0"
__all__ = ["EventLog", "__version__", "case_ids", "event_ids", "timestamps", "to_event_log", "trace_positions", "train_test_split"]
