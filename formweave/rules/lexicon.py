"""Label lexicon and autocomplete tokens."""

from __future__ import annotations

from typing import NamedTuple


class LexiconEntry(NamedTuple):
    key: str
    exact: list[str]
    contains: list[str]
    section_any: list[str]


# Keys, spellings and their order decide which rule wins.  Per
# entry: key, exact spellings, contained phrases, section words.
LEXICON = [
    LexiconEntry(
        "preferences.requiresSponsorship",
        [],
        [
            "require sponsorship", "need sponsorship", "require visa sponsorship", "require immigration sponsorship",
            "now or in the future require sponsorship", "sponsorship to work",
        ],
        [],
    ),
    LexiconEntry(
        "preferences.workAuth",
        [],
        [
            "legally authorized to work", "legally authorised to work", "authorized to work", "authorised to work",
            "eligible to work", "eligibility to work", "right to work", "work authorization", "work authorisation",
        ],
        [],
    ),
    LexiconEntry(
        "preferences.salaryMin",
        ["minimum salary", "salary minimum", "salary from", "base salary minimum"],
        ["minimum salary", "minimum expected salary", "minimum compensation", "salary range from"],
        [],
    ),
    LexiconEntry(
        "preferences.salaryMax",
        ["maximum salary", "salary maximum", "salary to", "base salary maximum"],
        ["maximum salary", "maximum expected salary", "maximum compensation", "salary range to"],
        [],
    ),
    LexiconEntry(
        "preferences.salary",
        [],
        [
            "salary expectation", "expected salary", "desired salary", "compensation expectation",
            "desired compensation", "salary requirement",
        ],
        [],
    ),
    LexiconEntry(
        "skills.list",
        ["skills", "technical skills", "technologies", "tech stack", "key skills", "core skills"],
        ["which of the following skills", "which of the following technologies", "select your skills"],
        [],
    ),
    LexiconEntry(
        "preferences.startDate",
        [],
        ["earliest start date", "available to start", "availability date", "when can you start"],
        [],
    ),
    LexiconEntry(
        "preferences.noticePeriod",
        [],
        ["notice period"],
        [],
    ),
    LexiconEntry(
        "preferences.relocation",
        [],
        ["willing to relocate", "open to relocat", "able to relocate"],
        [],
    ),
    LexiconEntry(
        "preferences.remote",
        [],
        ["remote work preference", "work preference remote", "prefer to work remote"],
        [],
    ),
    LexiconEntry(
        "preferences.howHeard",
        [],
        ["how did you hear", "how you heard", "where did you hear"],
        [],
    ),
    LexiconEntry(
        "eeo.gender",
        ["gender", "gender identity", "sex"],
        ["gender identity"],
        [],
    ),
    LexiconEntry(
        "eeo.hispanic",
        [],
        ["hispanic or latino", "hispanic latino", "latinx"],
        [],
    ),
    LexiconEntry(
        "eeo.race",
        ["race", "ethnicity", "race ethnicity"],
        ["racial or ethnic", "race and or ethnicity", "identify your race"],
        [],
    ),
    LexiconEntry(
        "eeo.veteran",
        [],
        ["veteran status", "protected veteran"],
        [],
    ),
    LexiconEntry(
        "eeo.disability",
        [],
        ["disability status", "have a disability"],
        [],
    ),
    LexiconEntry(
        "links.linkedin",
        [],
        ["linkedin"],
        [],
    ),
    LexiconEntry(
        "links.github",
        [],
        ["github"],
        [],
    ),
    LexiconEntry(
        "links.portfolio",
        [],
        ["portfolio"],
        [],
    ),
    LexiconEntry(
        "links.website",
        ["website", "personal website", "web site"],
        ["personal website"],
        [],
    ),
    LexiconEntry(
        "basics.firstName",
        ["first name", "given name", "forename", "legal first name", "preferred first name"],
        [],
        [],
    ),
    LexiconEntry(
        "basics.lastName",
        ["last name", "family name", "surname", "legal last name"],
        [],
        [],
    ),
    LexiconEntry(
        "basics.fullName",
        ["full name", "name", "your name", "full legal name", "legal name"],
        [],
        [],
    ),
    LexiconEntry(
        "basics.email",
        ["email", "email address", "e mail", "e mail address", "contact email"],
        [],
        [],
    ),
    LexiconEntry(
        "basics.phone",
        ["phone", "phone number", "mobile", "mobile number", "cell phone", "telephone", "contact number"],
        ["phone number"],
        [],
    ),
    LexiconEntry(
        "basics.pronouns",
        ["pronouns", "preferred pronouns"],
        [],
        [],
    ),
    LexiconEntry(
        "location.street",
        ["street address", "address line 1", "address line", "street", "home address"],
        ["address line 1", "street address"],
        [],
    ),
    LexiconEntry(
        "location.full",
        ["location", "current location", "address", "where are you located", "city state"],
        ["current location", "where are you based", "where are you located"],
        [],
    ),
    LexiconEntry(
        "location.city",
        ["city", "town", "current city", "city of residence"],
        [],
        [],
    ),
    LexiconEntry(
        "location.region",
        ["state", "province", "region", "state province", "county", "state region", "state or province"],
        [],
        [],
    ),
    LexiconEntry(
        "location.country",
        ["country", "country of residence", "current country", "country region"],
        [],
        [],
    ),
    LexiconEntry(
        "location.postalCode",
        ["zip", "zip code", "postal code", "postcode"],
        [],
        [],
    ),
    LexiconEntry(
        "basics.phoneCountryCode",
        ["country code", "phone country code", "dial code", "country calling code", "phone country"],
        ["country dial code", "phone country code"],
        [],
    ),
    LexiconEntry(
        "work.company",
        ["company", "current company", "employer", "current employer", "most recent company", "organization"],
        [],
        [],
    ),
    LexiconEntry(
        "work.title",
        ["title", "job title", "current title", "role", "current role", "position", "most recent title"],
        [],
        [],
    ),
    LexiconEntry(
        "work.start",
        ["start date", "from"],
        [],
        ["experience", "employment", "work history", "work"],
    ),
    LexiconEntry(
        "work.end",
        ["end date", "to"],
        [],
        ["experience", "employment", "work history", "work"],
    ),
    LexiconEntry(
        "education.school",
        ["school", "university", "college", "institution", "school name", "alma mater"],
        [],
        [],
    ),
    LexiconEntry(
        "education.degree",
        ["degree", "highest degree", "education level", "degree level", "highest level of education"],
        [],
        [],
    ),
    LexiconEntry(
        "education.field",
        ["major", "field of study", "discipline", "area of study", "concentration"],
        [],
        [],
    ),
    LexiconEntry(
        "education.gpa",
        ["gpa", "grade point average"],
        [],
        [],
    ),
    LexiconEntry(
        "education.start",
        ["start date", "from"],
        [],
        ["education", "school", "university"],
    ),
    LexiconEntry(
        "education.end",
        ["end date", "graduation date", "to", "graduation year"],
        [],
        ["education", "school", "university"],
    ),
    LexiconEntry(
        "attachments.resume",
        ["resume", "cv", "resume cv", "upload resume", "attach resume", "resume or cv"],
        ["resume", "curriculum vitae"],
        [],
    ),
    LexiconEntry(
        "attachments.coverLetter",
        [],
        ["cover letter"],
        [],
    ),
]

AUTOCOMPLETE = {
    "given-name": "basics.firstName",
    "additional-name": "basics.fullName",
    "family-name": "basics.lastName",
    "name": "basics.fullName",
    "email": "basics.email",
    "tel": "basics.phone",
    "tel-national": "basics.phone",
    "tel-country-code": "basics.phoneCountryCode",
    "url": "links.website",
    "address-level1": "location.region",
    "address-level2": "location.city",
    "postal-code": "location.postalCode",
    "country": "location.country",
    "country-name": "location.country",
    "street-address": "location.street",
    "address-line1": "location.street",
    "organization": "work.company",
    "organization-title": "work.title",
}

CANONICAL_KEYS = [
    "basics.firstName", "basics.lastName", "basics.fullName", "basics.email", "basics.phone",
    "basics.phoneCountryCode", "basics.pronouns", "location.street", "location.city", "location.region",
    "location.country", "location.postalCode", "location.full", "links.linkedin", "links.github", "links.portfolio",
    "links.website", "links.other", "work.company", "work.title", "work.start", "work.end", "work.current",
    "work.description", "education.school", "education.degree", "education.field", "education.start",
    "education.end", "education.gpa", "skills.list", "preferences.workAuth", "preferences.requiresSponsorship",
    "preferences.salary", "preferences.salaryMin", "preferences.salaryMax", "preferences.startDate",
    "preferences.relocation", "preferences.remote", "preferences.noticePeriod", "preferences.howHeard", "eeo.gender",
    "eeo.race", "eeo.hispanic", "eeo.veteran", "eeo.disability", "attachments.resume", "attachments.coverLetter",
]
# end of fixed values


def lexicon() -> list[LexiconEntry]:
    return LEXICON


def autocomplete_tokens() -> dict[str, str]:
    return AUTOCOMPLETE
