"""What a model is to predict. Targets look ahead and are kept apart from features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.eventlog import EventLog, to_event_log
from eventloom.functions import time
from eventloom.schema import KEYS, in_order

#: Stands for the activity after a case's last event.
EOT_TOKEN = "<EOT>"


def next_activity(log: DataFrame | EventLog) -> DataFrame:
    """The keys and next_activity: the case's next activity, EOT_TOKEN after the last; a null activity stays null."""
    df = to_event_log(log)
    default = F.lit(EOT_TOKEN).try_cast(df.schema["activity"].dataType)
    following = F.lead(F.struct("activity")).over(in_order())
    return df.select(*KEYS, F.when(following.isNull(), default).otherwise(following["activity"]).alias("next_activity"))


def remaining_time(log: DataFrame | EventLog, time_unit: str = "s") -> DataFrame:
    return to_event_log(log).select(*KEYS, time.remaining_time(time_unit).alias("remaining_time"))


def execution_time(log: DataFrame | EventLog, time_unit: str = "s") -> DataFrame:
    return to_event_log(log).select(*KEYS, time.execution_time(time_unit).alias("execution_time"))
