"""Declared table schemas; nothing is inferred."""

from __future__ import annotations

OPTION = "struct<value:string,text:string>"

SIGNALS = f"""
cand string, page_id string, pos int, ref string, frame_path string, selector string,
member_selectors array<string>, kind string, label string, label_source string, placeholder string,
name_attr string, id_attr string, autocomplete string, required boolean, options array<{OPTION}>,
current_value string, section_heading string, visible boolean, in_shadow boolean, group_id string,
widget_hint string, accept string, max_length int, ats string, company string, role string,
date_format_hint string
"""

WORK = "struct<company:string,title:string,start:string,end:string,current:boolean,location:string,description:string>"
EDUCATION = "struct<school:string,degree:string,field:string,start:string,end:string,gpa:string>"
EXPLICIT = (
    "struct<workAuth:string,requiresSponsorship:string,salary:string,salaryMin:string,salaryMax:string,"
    "startDate:string,relocation:string,remote:string,noticePeriod:string,gender:string,race:string,"
    "hispanic:string,veteran:string,disability:string>"
)
PROFILES = f"""
cand string, version int,
basics struct<firstName:string,lastName:string,email:string,phone:string,pronouns:string>,
location struct<street:string,city:string,region:string,country:string,postalCode:string>,
links struct<linkedin:string,github:string,portfolio:string,website:string>,
work array<{WORK}>, education array<{EDUCATION}>, skills array<string>, explicit {EXPLICIT}
"""

ANSWERS = """
cand string, id string, question_text string, normalized_key string, alias_keys array<string>,
answer string, times_used long, last_used_us long, created_us long
"""

DOCUMENTS = "cand string, id string, role string, file_name string, mime string, size long, added_us long"

FILL_LOG = """
cand string, id string, at_us long, domain string, ats string, field_count int, filled int, reviewed int,
abstained int, failed int, duration_ms long,
outcomes array<struct<canonical:string,kind:string,source:string,confidence:double,outcome:string,error:string>>
"""

SETTINGS = """
cand string, passphrase_enabled boolean, work_everywhere boolean, date_format_hint string, auto_detect boolean
"""

GOLDEN = """
url string,
fields array<struct<selector:string,canonical:string,kind:string,required:boolean,viaSavedAnswer:boolean>>,
expectNoFill array<string>
"""

USAGE_EVENTS = "client_id string, event_id long, ts_us long, event string, params_json string, once boolean"

# The permitted members of each enumeration.
KINDS = (
    "text email tel url number date textarea select multiselect radio_group checkbox file "
    "aria_combobox aria_listbox contenteditable"
).split()
OUTCOMES = ["filled", "review", "abstain", "failed"]
JOB_STATUSES = ["saved", "applied", "interviewing", "offer", "rejected"]
DOCUMENT_ROLES = ["resume", "coverLetter"]
