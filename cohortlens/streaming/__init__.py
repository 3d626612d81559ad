"""Structured Streaming forms of the activity-log profile.

The reference has no streams (its logs are finished files); this package only
maintains the same frequency profile incrementally when log files keep
arriving.  No windows or watermarks are needed: the profile has no event-time
semantics.
"""

from cohortlens.streaming.event_profile import frequency_stream, read_log_stream, run_available  # noqa: F401
