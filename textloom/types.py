"""Data model: documents are strings, spans are half-open ranges of code points."""

from __future__ import annotations

SPAN = "struct<start: int, end: int, type: string, confidence: double, reason: string>"
SPANS = f"array<{SPAN}>"
REPLACEMENTS = "array<struct<start: int, end: int, original: string, replacement: string>>"

#: The entity types in catalogue order.
TYPES = (
    "PERSON BIRTH_DATE BIRTH_PLACE PASSPORT CITIZENSHIP PASSPORT_ISSUER DEPARTMENT_CODE PASSPORT_DATE DRIVER_LICENSE ADDRESS COUNTRY POSTAL_CODE CITY STREET HOUSE APARTMENT "
    "EMAIL PHONE INN CARD CVV PIN CARDHOLDER FOREIGN_DOCUMENT LOCATION SNILS OMS IP_ADDRESS URL MILITARY_ID BIRTH_CERTIFICATE"
).split()
#: Which type wins where spans overlap.
PRIORITY = {
    "FOREIGN_DOCUMENT": 110, "BIRTH_CERTIFICATE": 110, "PASSPORT": 105, "DRIVER_LICENSE": 104, "BIRTH_DATE": 103, "PASSPORT_DATE": 103, "DEPARTMENT_CODE": 103, "CARDHOLDER": 102,
    "PASSPORT_ISSUER": 101, "BIRTH_PLACE": 100, "ADDRESS": 99, "CARD": 95, "INN": 94, "PHONE": 90, "EMAIL": 90, "PERSON": 80, "LOCATION": 70,
}
DEFAULT_PRIORITY, MODEL_PRIORITY, REGIONAL_FLOOR = 85, 65, 96
MODES = ("mask", "token", "synthetic")
