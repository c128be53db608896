"""Usage-event allowlist."""

from __future__ import annotations

# Event and its permitted parameters, and names never permitted.
EVENT_SCHEMA = {
    "extension_installed": ["version"],
    "extension_updated": ["version"],
    "onboarding_started": ["surface"],
    "resume_import_started": ["method"],
    "resume_imported": ["method", "warnings"],
    "resume_import_failed": ["method", "reason"],
    "onboarding_completed": ["method", "hours_since_install"],
    "application_page_detected": ["ats"],
    "first_application_detected": ["ats", "hours_since_install"],
    "fill_completed": ["ats", "via", "field_count", "filled", "reviewed", "abstained", "failed", "duration_ms"],
    "first_fill_completed": ["ats", "hours_since_install"],
    "fill_failed": ["ats", "reason"],
    "fill_undone": ["ats"],
    "panel_opened": ["surface"],
    "shortcut_used": ["command"],
    "application_marked_applied": ["ats"],
    "first_application_marked": ["hours_since_install"],
    "saved_answer_created": ["count"],
    "saved_answer_reused": ["count"],
    "followup_reminder_set": ["days_ahead"],
    "followup_notification_sent": [],
    "followup_notification_clicked": [],
    "heartbeat": ["jobs_total", "jobs_applied", "answers_total", "documents_total", "days_since_install", "version"],
    "settings_changed": ["field"],
    "telemetry_opt_out": [],
    "extension_error": ["context", "message"],
}
FORBIDDEN_PARAMS = [
    "url", "href", "hostname", "origin", "domain", "page", "title", "company", "question", "label", "answer",
    "value", "text", "content", "resume", "cv", "name", "email", "phone", "address", "salary", "jd", "notes",
    "profile", "passphrase", "api_key",
]
MAX_STRING_LENGTH = 100
SESSION_GAP_MINUTES = 30
MAX_ERRORS_PER_CONTEXT_PER_DAY = 20
ENGAGEMENT_TIME_MSEC = 100
# end of fixed values


def event_schema() -> dict[str, list[str]]:
    return EVENT_SCHEMA
