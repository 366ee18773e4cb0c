"""Default values of the operators' parameters."""

from __future__ import annotations

# What the original report used, in the order its steps use them.
LINE_TZ = "America/Chicago"  # wall clock of the line's records
SHIFT_END_HOURS = (5, 15)  # local hours at which the shift summary is added
NOK_STATUS = "NOK"
OK_STATUS = "OK"
ORIGINAL_ALARM_COLUMNS = {  # the original alarm table's names of the columns that the alarm operators read
    "alarm_source": "alarm_source_scada_short_name",
    "alarm_priority": "alarm_priority_desc",
}
ALARM_PRIORITIES = ("high", "critical")  # alarm priorities that are counted
DEBOUNCE_SECONDS = 30  # an alarm starting within this gap after the previous one cleared is not counted
TAG_MARKER = "Key"  # alarm text marker before the bracketed tag
ORIGIN_PARAMETER = "Nest"  # parameter of the origin station's record of a child part
SPOOL_MARKER = "C"  # spool code: characters after this marker
SPOOL_LENGTH = 8
PAIR_WIDTH = 5  # pair label: characters on each side of the separator
PAIR_SEPARATOR = "&"
