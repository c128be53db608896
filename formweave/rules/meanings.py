"""Spellings that mean the same option: alias groups, countries, states."""

from __future__ import annotations

import re
import unicodedata

# Each list is a group of spellings of one option value.
ALIAS_GROUPS = [
    ["united states", "usa", "us", "united states of america", "u s", "u s a"],
    ["united kingdom", "uk", "great britain", "u k"],
    ["yes", "y", "true", "i am", "i do"],
    ["no", "n", "false", "i am not", "i do not", "i dont"],
    [
        "prefer not to say", "prefer not to answer", "decline to self identify", "decline to answer",
        "i dont wish to answer", "prefer not to disclose",
    ],
    ["male", "man"],
    ["female", "woman"],
    ["non binary", "nonbinary", "non binary genderqueer or gender non conforming"],
    [
        "bachelors", "bachelors degree", "bachelor s degree", "bs", "ba", "bsc", "beng", "b s", "b a",
        "undergraduate degree",
    ],
    ["masters", "masters degree", "master s degree", "ms", "ma", "msc", "meng", "m s", "m a", "graduate degree"],
    ["doctorate", "phd", "ph d", "doctoral degree"],
    ["high school", "high school diploma", "ged", "secondary school"],
    ["remote", "fully remote", "remote only"],
    ["hybrid", "partially remote"],
    ["onsite", "on site", "in office", "in person"],
    [
        "i am not a protected veteran", "i am not a veteran", "not a protected veteran",
        "no i am not a protected veteran",
    ],
    ["i dont wish to answer veteran", "i decline to self identify veteran"],
    ["no i do not have a disability", "no i dont have a disability or have a history record of having a disability"],
    ["yes i have a disability", "yes i have a disability or previously had a disability"],
]

# ISO code, dial code, names
COUNTRIES = [
    ("US", "1", ["United States", "United States of America", "USA", "U.S.", "U.S.A.", "America", "USA United States"]),
    ("GB", "44", [
        "United Kingdom", "UK", "Great Britain", "England", "Britain",
        "United Kingdom of Great Britain and Northern Ireland",
    ]),
    ("CA", "1", ["Canada"]),
    ("AU", "61", ["Australia"]),
    ("NZ", "64", ["New Zealand"]),
    ("IE", "353", ["Ireland", "Republic of Ireland"]),
    ("ZA", "27", ["South Africa", "RSA"]),
    ("ZW", "263", ["Zimbabwe"]),
    ("NG", "234", ["Nigeria"]),
    ("KE", "254", ["Kenya"]),
    ("GH", "233", ["Ghana"]),
    ("EG", "20", ["Egypt"]),
    ("MA", "212", ["Morocco"]),
    ("ET", "251", ["Ethiopia"]),
    ("TZ", "255", ["Tanzania"]),
    ("UG", "256", ["Uganda"]),
    ("ZM", "260", ["Zambia"]),
    ("BW", "267", ["Botswana"]),
    ("NA", "264", ["Namibia"]),
    ("MZ", "258", ["Mozambique"]),
    ("MW", "265", ["Malawi"]),
    ("RW", "250", ["Rwanda"]),
    ("SN", "221", ["Senegal"]),
    ("CI", "225", ["Ivory Coast", "Cote d'Ivoire", "Côte d'Ivoire"]),
    ("CM", "237", ["Cameroon"]),
    ("DE", "49", ["Germany", "Deutschland"]),
    ("FR", "33", ["France"]),
    ("ES", "34", ["Spain", "España"]),
    ("PT", "351", ["Portugal"]),
    ("IT", "39", ["Italy", "Italia"]),
    ("NL", "31", ["Netherlands", "The Netherlands", "Holland"]),
    ("BE", "32", ["Belgium"]),
    ("CH", "41", ["Switzerland"]),
    ("AT", "43", ["Austria"]),
    ("SE", "46", ["Sweden"]),
    ("NO", "47", ["Norway"]),
    ("DK", "45", ["Denmark"]),
    ("FI", "358", ["Finland"]),
    ("IS", "354", ["Iceland"]),
    ("PL", "48", ["Poland"]),
    ("CZ", "420", ["Czech Republic", "Czechia"]),
    ("SK", "421", ["Slovakia"]),
    ("HU", "36", ["Hungary"]),
    ("RO", "40", ["Romania"]),
    ("BG", "359", ["Bulgaria"]),
    ("GR", "30", ["Greece"]),
    ("HR", "385", ["Croatia"]),
    ("SI", "386", ["Slovenia"]),
    ("RS", "381", ["Serbia"]),
    ("UA", "380", ["Ukraine"]),
    ("EE", "372", ["Estonia"]),
    ("LV", "371", ["Latvia"]),
    ("LT", "370", ["Lithuania"]),
    ("TR", "90", ["Turkey", "Türkiye", "Turkiye"]),
    ("IL", "972", ["Israel"]),
    ("AE", "971", ["United Arab Emirates", "UAE", "Dubai"]),
    ("SA", "966", ["Saudi Arabia", "KSA"]),
    ("QA", "974", ["Qatar"]),
    ("KW", "965", ["Kuwait"]),
    ("BH", "973", ["Bahrain"]),
    ("OM", "968", ["Oman"]),
    ("JO", "962", ["Jordan"]),
    ("LB", "961", ["Lebanon"]),
    ("IN", "91", ["India", "Bharat"]),
    ("PK", "92", ["Pakistan"]),
    ("BD", "880", ["Bangladesh"]),
    ("LK", "94", ["Sri Lanka"]),
    ("NP", "977", ["Nepal"]),
    ("CN", "86", ["China", "People's Republic of China", "PRC", "Mainland China"]),
    ("HK", "852", ["Hong Kong", "Hong Kong SAR"]),
    ("TW", "886", ["Taiwan", "Chinese Taipei"]),
    ("JP", "81", ["Japan"]),
    ("KR", "82", ["South Korea", "Korea, South", "Republic of Korea", "Korea Republic of", "Korea"]),
    ("SG", "65", ["Singapore"]),
    ("MY", "60", ["Malaysia"]),
    ("TH", "66", ["Thailand"]),
    ("VN", "84", ["Vietnam", "Viet Nam"]),
    ("PH", "63", ["Philippines", "The Philippines"]),
    ("ID", "62", ["Indonesia"]),
    ("MX", "52", ["Mexico", "México"]),
    ("BR", "55", ["Brazil", "Brasil"]),
    ("AR", "54", ["Argentina"]),
    ("CL", "56", ["Chile"]),
    ("CO", "57", ["Colombia"]),
    ("PE", "51", ["Peru", "Perú"]),
    ("UY", "598", ["Uruguay"]),
    ("EC", "593", ["Ecuador"]),
    ("CR", "506", ["Costa Rica"]),
    ("PA", "507", ["Panama"]),
    ("DO", "1", ["Dominican Republic"]),
    ("JM", "1", ["Jamaica"]),
    ("TT", "1", ["Trinidad and Tobago"]),
    ("RU", "7", ["Russia", "Russian Federation"]),
    ("KZ", "7", ["Kazakhstan"]),
    ("GE", "995", ["Georgia"]),
    ("AM", "374", ["Armenia"]),
    ("AZ", "994", ["Azerbaijan"]),
]

# region prefix: codes and names; the first spelling loaded wins
STATES = {
    "US": {
        "AL": "Alabama",
        "AK": "Alaska",
        "AZ": "Arizona",
        "AR": "Arkansas",
        "CA": "California",
        "CO": "Colorado",
        "CT": "Connecticut",
        "DE": "Delaware",
        "FL": "Florida",
        "GA": "Georgia",
        "HI": "Hawaii",
        "ID": "Idaho",
        "IL": "Illinois",
        "IN": "Indiana",
        "IA": "Iowa",
        "KS": "Kansas",
        "KY": "Kentucky",
        "LA": "Louisiana",
        "ME": "Maine",
        "MD": "Maryland",
        "MA": "Massachusetts",
        "MI": "Michigan",
        "MN": "Minnesota",
        "MS": "Mississippi",
        "MO": "Missouri",
        "MT": "Montana",
        "NE": "Nebraska",
        "NV": "Nevada",
        "NH": "New Hampshire",
        "NJ": "New Jersey",
        "NM": "New Mexico",
        "NY": "New York",
        "NC": "North Carolina",
        "ND": "North Dakota",
        "OH": "Ohio",
        "OK": "Oklahoma",
        "OR": "Oregon",
        "PA": "Pennsylvania",
        "RI": "Rhode Island",
        "SC": "South Carolina",
        "SD": "South Dakota",
        "TN": "Tennessee",
        "TX": "Texas",
        "UT": "Utah",
        "VT": "Vermont",
        "VA": "Virginia",
        "WA": "Washington",
        "WV": "West Virginia",
        "WI": "Wisconsin",
        "WY": "Wyoming",
        "DC": "District of Columbia",
    },
    "CA": {
        "AB": "Alberta",
        "BC": "British Columbia",
        "MB": "Manitoba",
        "NB": "New Brunswick",
        "NL": "Newfoundland and Labrador",
        "NS": "Nova Scotia",
        "ON": "Ontario",
        "PE": "Prince Edward Island",
        "QC": "Quebec",
        "SK": "Saskatchewan",
        "NT": "Northwest Territories",
        "NU": "Nunavut",
        "YT": "Yukon",
    },
    "ZA": {
        "EC": "Eastern Cape",
        "FS": "Free State",
        "GP": "Gauteng",
        "KZN": "KwaZulu-Natal",
        "LP": "Limpopo",
        "MP": "Mpumalanga",
        "NC": "Northern Cape",
        "NW": "North West",
        "WC": "Western Cape",
    },
}
# end of fixed values


def fold_ascii(s: str) -> str:
    """Key form of a place name: lower case, marks removed, ASCII words only."""
    plain = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return " ".join(re.sub(r"[^a-z0-9]", " ", plain).split())


def alias_groups() -> dict[str, int]:
    return {spelling: group for group, spellings in enumerate(ALIAS_GROUPS) for spelling in spellings}


def country_aliases() -> dict[str, str]:
    """Folded spelling -> ISO code; a later row replaces an earlier spelling."""
    return {fold_ascii(n): iso2 for iso2, _, names in COUNTRIES for n in [iso2, *names]}


def country_dials() -> dict[str, str]:
    return {iso2: dial for iso2, dial, _ in COUNTRIES}


def state_aliases() -> dict[str, str]:
    """Folded spelling -> 'REGION:CODE'; the first row keeps a shared spelling."""
    out: dict[str, str] = {}
    for prefix, names in STATES.items():
        for code, name in names.items():
            for spelling in (code, name):
                out.setdefault(fold_ascii(spelling), f"{prefix}:{code}")
    return out


def mark_folding() -> tuple[str, str]:
    """(from, to) for translate(): accented Latin letters to ASCII, marks dropped.

    Derived from Unicode decomposition rather than listed.
    """
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if base != ch and len(base) == 1 and base.isascii():
            src.append(ch)
            dst.append(base.lower())
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(src + marks), "".join(dst)
