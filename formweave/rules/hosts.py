"""Job-board hosts and the per-board field rules."""

from __future__ import annotations

from typing import NamedTuple

# Ordered host patterns (first match wins) and, per board, the
# ordered id/name patterns of its standard fields.
ATS_HOSTS = [
    ("greenhouse", r"(?i)(^|\.)greenhouse\.io$"),
    ("greenhouse", r"(?i)(^|\.)job-boards\.greenhouse\.io$"),
    ("lever", r"(?i)(^|\.)jobs\.lever\.co$"),
    ("ashby", r"(?i)(^|\.)jobs\.ashbyhq\.com$"),
]

# board, key, id pattern, name pattern
ADAPTERS = [
    ("greenhouse", "basics.firstName", r"^first_name$", r"^job_application\[first_name\]$"),
    ("greenhouse", "basics.lastName", r"^last_name$", r"^job_application\[last_name\]$"),
    ("greenhouse", "basics.email", r"^email$", r"^job_application\[email\]$"),
    ("greenhouse", "basics.phone", r"^phone$", r"^job_application\[phone\]$"),
    ("greenhouse", "location.full", r"^(job_application_location|candidate-location|auto_complete_input)$", None),
    ("greenhouse", "attachments.resume", r"^resume$", r"^job_application\[resume\]$"),
    ("greenhouse", "attachments.coverLetter", r"^cover_letter$", r"^job_application\[cover_letter\]$"),
    ("greenhouse", "eeo.gender", r"^job_application_gender$", r"^job_application\[gender\]$"),
    ("greenhouse", "eeo.hispanic", r"^job_application_hispanic_ethnicity$", r"^job_application\[hispanic_ethnicity\]$"),
    ("greenhouse", "eeo.race", r"^job_application_race$", r"^job_application\[race\]$"),
    ("greenhouse", "eeo.veteran", r"^job_application_veteran_status$", r"^job_application\[veteran_status\]$"),
    ("greenhouse", "eeo.disability", r"^job_application_disability_status$", r"^job_application\[disability_status\]$"),
    ("lever", "basics.fullName", None, r"^name$"),
    ("lever", "basics.email", None, r"^email$"),
    ("lever", "basics.phone", None, r"^phone$"),
    ("lever", "work.company", None, r"^org$"),
    ("lever", "location.full", None, r"^location$"),
    ("lever", "links.linkedin", None, r"(?i)^urls\[LinkedIn\]$"),
    ("lever", "links.github", None, r"^urls\[Git[Hh]ub\]$"),
    ("lever", "links.portfolio", None, r"(?i)^urls\[Portfolio\]$"),
    ("lever", "links.website", None, r"(?i)^urls\[(Other|Website)\]$"),
    ("lever", "attachments.resume", None, r"^resume$"),
    ("lever", "eeo.gender", None, r"^eeo\[gender\]$"),
    ("lever", "eeo.race", None, r"^eeo\[race\]$"),
    ("lever", "eeo.veteran", None, r"^eeo\[veteran\]$"),
    ("lever", "eeo.disability", None, r"^eeo\[disability\]$"),
    ("ashby", "basics.fullName", r"^_systemfield_name$", None),
    ("ashby", "basics.email", r"^_systemfield_email$", None),
    ("ashby", "basics.phone", r"^_systemfield_phone$", None),
    ("ashby", "location.full", r"^_systemfield_location$", None),
    ("ashby", "attachments.resume", r"^_systemfield_resume$", None),
]
# end of fixed values


class AdapterRule(NamedTuple):
    ats: str
    key: str
    id_re: str | None
    name_re: str | None


def adapter_rules() -> list[AdapterRule]:
    return [AdapterRule(*rule) for rule in ADAPTERS]
