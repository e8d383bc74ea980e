"""Word lists, lookup tables, constants and patterns that results depend on.

They are stated as they have to be, in their natural order; nothing here is logic.
"""

# --- fixed values: types, classes, routing -------------------------------------------------

#: Entity type -> regulatory class, for reports only. Types not listed are PII.
DATA_CLASS = {
    "NAME": "PII",
    "SSN": "PII",
    "DOB": "PII",
    "DATE": "PHI",
    "ADDRESS": "PII",
    "ZIP": "PII",
    "EMAIL": "PII",
    "PHONE": "PII",
    "MRN": "PHI",
    "ACCOUNT": "FINANCIAL",
    "INSURANCE_ID": "PHI",
    "CREDIT_CARD": "FINANCIAL",
    "IP": "PII",
    "URL": "PII",
    "DIAGNOSIS": "PHI",
    "MEDICATION": "PHI",
    "ETHNICITY": "PHI",
    "AGE": "PHI",
    "SEX": "PHI",
    "LEGAL_CASE": "LEGAL",
    "ACCOUNT_FINANCIAL": "FINANCIAL",
    "GENERIC_ID": "PII",
}
ENTITY_TYPES = tuple(DATA_CLASS)
ACTIONS = ("TOKENIZE", "PSEUDONYMIZE", "GENERALIZE", "REDACT", "PRESERVE", "ROUTE_TO_HUMAN")
#: Types that are not tokenized unless a policy says so.
ROUTING = {"ZIP": "GENERALIZE", "DOB": "GENERALIZE", "DATE": "GENERALIZE", "ETHNICITY": "PRESERVE", "SEX": "PRESERVE", "AGE": "PRESERVE"}
REDACTED = "[redacted]"
DIGEST_CHARS = 12
#: A token; the class of type tags has the underscore that some tags hold.
TOKEN = r"\[([A-Z][A-Z0-9_]*)_([0-9a-f]{12})\]"
TOKEN_ANY_CASE = r"(?i)\[([A-Z][A-Z0-9_]*)_([0-9a-f]{12})\]"

# --- fixed values: word lists --------------------------------------------------------------

SEX_TERMS = ["male", "female", "man", "woman", "transgender", "nonbinary", "non-binary"]
ETHNICITY_TERMS = [
    "White", "Black", "African American", "Asian", "Han Chinese", "Hispanic", "Latino",
    "Latina", "Native American", "Pacific Islander", "Ashkenazi", "Caucasian", "Korean",
    "Japanese", "Vietnamese", "Filipino", "South Asian", "Middle Eastern",
]
HONORIFICS = ["Dr", "Mr", "Mrs", "Ms", "Miss", "Prof", "Rev", "Hon"]
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH "
    "NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
#: State codes that are words: no city is read before them.
STATE_WORDS = ["OR", "IN", "OK", "HI", "ME", "OH"]
#: Words that are also names: a lone one is not taken for the person.
COMMON_NAMES = (
    "will may mark grace june bill rose dawn hope art guy sun faith joy hazel holly ivy jean gene "
    "frank rich hero major pearl ray dale dean reed victor noel paige clay chase drew grant case "
    "lane brook brooke summer sky star angel miles rob robin jack mercy green baker young day"
).split()
#: Field labels that are no names when they stand alone.
LABEL_WORDS = (
    "email phone name address patient relationship spouse account insurance member policy provider "
    "physician attending contact emergency date birth sex gender age result reference test "
    "assessment plan history present illness laboratory results hospital record confidential page "
    "note signed electronically continue recheck reviewed subscriber docket case referring "
    "dr mr mrs ms miss prof rev hon"
).split()
#: Words that make a pair of capitalised words no name.
PAIR_WORDS = (
    "medical record blood pressure chief complaint date birth social security phone email address "
    "history present illness physical exam assessment plan review systems family patient progress "
    "note discharge summary vital signs heart rate attending physician provider primary care "
    "emergency contact united states new york san los case number account policy member insurance "
    "north south east west"
).split()
UNITS = [
    "mg", "mcg", "µg", "ug", "ng", "g", "kg", "mL", "ml", "L", "dL",
    "copies/mL", "copies/ml", "cells/µL", "cells/uL", "cells/mm3", "/mL", "/uL", "/µL",
    "mmHg", "bpm", "mmol/L", "mg/dL", "mEq/L", "IU", "units", "%", "cm", "mm", "kcal",
]
#: ZIP prefixes of fewer than 20,000 people.
SMALL_ZIP3 = ["036", "059", "063", "102", "203", "556", "692", "790", "821", "823", "830", "831", "878", "879", "884", "890", "893"]

# --- fixed values: patterns ----------------------------------------------------------------

NAME_PART = r"(?:[A-Z]\.|[A-Z][A-Za-z'’-]+)"
NAME = NAME_PART + r"(?:[ ]" + NAME_PART + r"){0,3}"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DATE = (
    r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}"
    rf"|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{MONTH}\s+\d{{4}})"
)
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
STREET = r"(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Ter)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
NAME_PAIR = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"

#: The standard rules in their order: id, name, type, what precedes, value, what follows,
#: priority, confidence, whether case is ignored. TERMS:x stands for the words of list x.
STANDARD_RULES = [
    ("ssn", "SSN", "SSN", None, r"\b\d{3}-\d{2}-\d{4}\b", None, 90, 0.97, True),
    ("ssn_labeled", "SSN (labeled)", "SSN", r"(?:SSN|Social Security(?:\s+(?:No|Number|#))?)\s*[:#]?\s*", r"\d{3}-?\d{2}-?\d{4}", None, 95, 0.98, True),
    ("email", "Email", "EMAIL", None, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", None, 90, 0.97, True),
    ("phone", "Phone", "PHONE", None, r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", None, 85, 0.9, True),
    ("credit_card", "Credit card", "CREDIT_CARD", None, r"\b(?:\d[ -]?){15,16}\b", None, 88, 0.9, True),
    ("ipv4", "IPv4", "IP", None, rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", None, 80, 0.9, True),
    ("url", "URL", "URL", None, r"\bhttps?://[^\s,)]+", None, 80, 0.9, True),
    ("mrn", "MRN", "MRN", r"(?:MRN|Medical Record(?:\s+(?:No|Number|#))?)\s*[:#]?\s*", r"[A-Z0-9-]{5,12}", None, 92, 0.95, True),
    ("dea", "DEA number", "GENERIC_ID", r"DEA(?:\s*(?:No|Number|#))?\s*[:#]?\s*", r"[A-Z]{2}\d{7}", None, 90, 0.95, True),
    ("npi", "NPI", "GENERIC_ID", r"NPI\s*[:#]?\s*", r"\d{10}", None, 88, 0.95, True),
    ("account", "Account number", "ACCOUNT", r"(?:Account|Acct)(?:\s*(?:No|Number|#))?\s*[:#]?\s*", r"[A-Z0-9-]{4,20}", None, 85, 0.9, True),
    ("insurance", "Insurance/Member ID", "INSURANCE_ID", r"(?:Member(?:\s+ID)?|Policy(?:\s+(?:No|Number|#))?|Insurance(?:\s+ID)?|Subscriber(?:\s+ID)?)\s*[:#]?\s*", r"[A-Z0-9-]{6,20}", None, 85, 0.9, True),
    ("case_no", "Legal case number", "LEGAL_CASE", r"(?:Case(?:\s+(?:No|Number|#))?|Docket(?:\s+(?:No|#))?)\s*[:#]?\s*", r"[A-Za-z0-9:-]{4,20}", None, 80, 0.9, True),
    ("name_labeled", "Name (labeled field)", "NAME", r"(?:Patient(?:\s+Name)?|Name|Provider|Physician|Attending|Guardian|Client|Plaintiff|Defendant|Emergency Contact|Contact|Referring(?:\s+Provider)?)\s*[:#][ \t]*", NAME, None, 78, 0.9, False),
    ("name_honorific", "Name (honorific)", "NAME", None, r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Rev)\.?[ \t]+" + NAME, None, 60, 0.75, False),
    ("dob", "Date of birth", "DOB", r"(?:DOB|D\.O\.B\.|Date of Birth|Birth\s*date)\s*[:#]?\s*", DATE, None, 90, 0.95, True),
    ("date", "Date", "DATE", None, DATE, None, 70, 0.85, True),
    ("age", "Age", "AGE", None, r"\b(\d{1,3})(?=[-\s]*(?:years?[-\s]*old|yo\b|y/o\b|y\.o\.))", None, 65, 0.85, True),
    ("age_labeled", "Age (labeled)", "AGE", r"Age\s*[:#]\s*", r"\d{1,3}", None, 70, 0.9, True),
    ("sex_labeled", "Sex (labeled)", "SEX", r"(?:Sex|Gender)\s*[:#]\s*", r"[A-Za-z-]+", None, 70, 0.9, True),
    ("sex_term", "Sex (term)", "SEX", None, "TERMS:SEX_TERMS", None, 40, 0.6, True),
    ("ethnicity", "Ethnicity/Race", "ETHNICITY", None, "TERMS:ETHNICITY_TERMS", None, 45, 0.7, True),
    ("address", "Street address", "ADDRESS", None, rf"\b\d{{1,6}}\s+(?:[A-Z][A-Za-z.]+\s){{1,4}}{STREET}\b\.?", None, 75, 0.85, True),
    ("city_state", "City (before state)", "ADDRESS", None, r"[A-Z][a-z]+(?:[ ][A-Z][a-z]+)?", r",[ ]+(?:" + "|".join(s for s in STATES if s not in STATE_WORDS) + r")\b", 76, 0.8, False),
]
# --- end of fixed values -------------------------------------------------------------------
