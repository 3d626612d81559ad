"""Sources and sinks (S1-S5) and the driver test tables."""

from cohortlens.sources.readers import (  # noqa: F401
    ACTIVITY_LOG_COLUMNS, ACTIVITY_LOG_SCHEMA, read_activity_log, read_dimension,
    read_table, read_by_year, sanitize_columns,
)
from cohortlens.sources.tables import load, student_wide, STUDENT_WIDE_SQL, WEEK_COLUMNS  # noqa: F401
from cohortlens.sources.sinks import description_lines, write_lines, write_table  # noqa: F401
