"""Detection patterns, written for code points and ASCII digits.

Each entry: id, pattern, entity type, confidence, detector.  Word borders are
those of Unicode letters (`(?U)` is added for the JVM).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    entity_type: str
    confidence: float
    detector: str
    stop: tuple[str, ...] = ()
    check: str | None = None  # "iban" or "lei"
    low: float = 0.0  # confidence where the check fails


# What counts as a match, with ASCII digits.
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
POSTCODE = r"(?i)\b(?:GIR ?0AA|[A-PR-UWYZ](?:[0-9][0-9A-HJKPS-UW]?|[A-HK-Y][0-9][0-9ABEHMNPRV-Y]?) ?[0-9][ABD-HJLNP-UW-Z]{2})\b"
LEI = r"\b[0-9A-Z]{18}[0-9]{2}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}\b"
BIC = r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"
URL = r"(?i)\b(?:https?://|www\.)[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
COMPANY_PREFIXED, COMPANY_DIGITS = r"\b[A-Z]{2}[0-9]{6}\b", r"\b[0-9]{8}\b"
SORT_CODE = r"\b[0-9]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{2}\b"
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = r"(?i)\b(?:[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}|[0-9]{4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,2}|[0-9]{1,2}\s+" + MONTH + r"\s+[0-9]{2,4})\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
NINO_A = r"(?i)\b[ABCEGHJ-NPR-TW-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D]\b"
NINO_B = r"(?i)\b[A-CEGHJ-NPR-TW-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D]\b"
VAT = r"(?i)\b(?:GB|DE|FR|IT|ES|NL|IE)\s?[0-9]{8,12}\b"
# the first look-ahead only spares the look-behinds at other characters
PHONE = r"(?=[+0-9])(?:(?<=\s)|(?<=^)|(?<=:))\+?[0-9][0-9 \-().]{7,}[0-9](?=\s|$|[,;])"

# Words in the shape of a bank code, taken out by either variant.
BIC_STOP_A = ("COMPANY", "ADDRESS", "CONTACT")
BIC_STOP_B = ("COMPANY", "ADDRESS", "CONTACT", "BUSINESS", "MILLION")

# Entity types, confidences and detector names.
A = (
    Pattern("re_email", EMAIL, "EMAIL", 0.99, "regex.email"),
    Pattern("re_postcode", POSTCODE, "POSTCODE", 0.95, "regex.uk_postcode"),
    Pattern("re_lei", LEI, "LEI", 0.99, "regex.lei", check="lei", low=0.55),
    Pattern("re_iban", IBAN, "IBAN", 0.99, "regex.iban", check="iban", low=0.5),
    Pattern("re_bic", BIC, "SWIFT_BIC", 0.85, "regex.swift_bic", stop=BIC_STOP_A),
    Pattern("re_url", URL, "URL", 0.95, "regex.url"),
    Pattern("re_company_prefixed", COMPANY_PREFIXED, "COMPANY_REG_NO", 0.85, "regex.company_no"),
    Pattern("re_company", COMPANY_DIGITS, "COMPANY_REG_NO", 0.7, "regex.company_no"),
    Pattern("re_sort", SORT_CODE, "SORT_CODE", 0.75, "regex.sort_code"),
    Pattern("re_account", COMPANY_DIGITS, "BANK_ACCOUNT", 0.45, "regex.bank_account"),
    Pattern("re_date", DATE, "GENERIC_DATE", 0.7, "regex.date"),
    Pattern("re_ssn", SSN, "NATIONAL_ID", 0.95, "regex.us_ssn"),
    Pattern("re_nin", NINO_A, "NATIONAL_ID", 0.92, "regex.uk_nin"),
    Pattern("re_vat", VAT, "TAX_ID", 0.9, "regex.vat"),
    Pattern("re_phone", PHONE, "PHONE", 0.7, "regex.phone_fallback"),
)

B = (
    Pattern("b_re_email", EMAIL, "EMAIL", 0.99, "regex.email"),
    Pattern("b_re_url", URL, "URL", 0.95, "regex.url"),
    Pattern("b_re_postcode", POSTCODE, "POSTCODE", 0.95, "regex.uk_postcode"),
    Pattern("b_re_lei", LEI, "LEI", 0.9, "regex.lei"),
    Pattern("b_re_iban", IBAN, "IBAN", 0.9, "regex.iban"),
    Pattern("b_re_bic", BIC, "SWIFT_BIC", 0.85, "regex.swift_bic", stop=BIC_STOP_B),
    Pattern("b_re_ssn", SSN, "NATIONAL_ID", 0.95, "regex.us_ssn"),
    Pattern("b_re_nin", NINO_B, "NATIONAL_ID", 0.92, "regex.uk_nin"),
    Pattern("b_re_sort", SORT_CODE, "SORT_CODE", 0.75, "regex.sort_code"),
    Pattern("b_re_date", DATE, "GENERIC_DATE", 0.7, "regex.date"),
    Pattern("b_re_company", rf"(?:{COMPANY_PREFIXED}|{COMPANY_DIGITS})", "COMPANY_REG_NO", 0.7, "regex.company_no"),
    Pattern("b_re_phone", PHONE, "PHONE", 0.7, "regex.phone"),
)

#: Quality-check scans.
NAME = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,4}\b"
LEGAL = r"\b(?:Limited|Ltd|PLC|LLP|LLC|Inc|GmbH|AG|SA|NV|BV)\b"
ABBREVIATION = r"\b[A-Z]{2,6}\b"
NAME_BLOCK = ("The", "This", "That", "These", "Dear", "Client", "Company", "Account", "Sort", "Date", "Board", "Registered", "Passport", "Phone", "Website")
ABBREVIATION_BLOCK = ("PDF", "USD", "GBP", "EUR", "UK", "US", "EU", "ID", "IT", "HR", "CEO", "CFO")
