"""Types and fixed values of document screening."""

from __future__ import annotations

NOT_DETECTED = "Not Detected"

ISSUE = "struct<field:string,severity:string,message:string>"
BOX = "struct<text:string,bbox:struct<left:int,top:int,width:int,height:int>,confidence:double,line_num:int,block_num:int>"
FACTOR = "struct<factor:string,raw_score:double,weight:double,weighted_score:double,detail:string>"
LEDGER = "prev_hash string, timestamp string, document_id string, risk_score string, decision string, hash string, index long"
REGISTRY = (
    "id long, document_number string, document_type string, full_name string, nationality string, status string, "
    "expiry_date string, dob string, gender string, photo_path string, notes string, created_at string"
)

# Results depend on them.
TYPE_ALIASES = {
    "driving_license": "drivers_license",
    "driver_license": "drivers_license",
    "drivers_license": "drivers_license",
    "id_card": "national_id",
    "national_id": "national_id",
    "passport": "passport",
    "visa": "visa",
    "permit": "permit",
}
PASSPORT_FIELDS = ("Name", "Passport Number", "Nationality", "Date of Birth", "Date of Expiry", "Gender")
VISA_FIELDS = ("Visa Number", "Visa Type", "Entry Validation", "Stay Duration")
GENERIC_FIELDS = ("Name", "Document Number", "Date of Birth", "Date of Expiry", "Gender")
NUMBER_ALIASES = ("License Number", "ID Number", "Permit Number")
REQUIRED_FIELDS = {
    "passport": PASSPORT_FIELDS,
    "visa": VISA_FIELDS,
    "national_id": ("Name", "Document Number", "Date of Birth"),
    "drivers_license": ("Name", "Document Number", "Date of Birth", "Date of Expiry"),
    "permit": ("Name", "Document Number", "Date of Expiry"),
}
NUMBER_FIELD = {
    "passport": "Passport Number",
    "visa": "Visa Number",
    "national_id": "ID Number",
    "drivers_license": "License Number",
    "permit": "Permit Number",
}
NUMBER_SHAPE = {
    "passport": r"^[A-Z0-9]{6,9}$",
    "visa": r"^[A-Z0-9]{6,12}$",
    "national_id": r"^[A-Z0-9]{6,12}$",
    "drivers_license": r"^[A-Z0-9\-\s]{5,20}$",
    "permit": r"^[A-Z0-9\-\s]{4,20}$",
}
FIELD_FALLBACKS = {
    "License Number": ("Document Number", "ID Number"),
    "ID Number": ("Document Number", "License Number"),
    "Permit Number": ("Document Number",),
    "Document Number": ("License Number", "ID Number", "Permit Number"),
}
MAX_STAY = {"single": 180, "double": 270, "multiple": 365}
STATUS_SHOWN = {"valid": "Valid", "expired": "Expired", "blacklisted": "Blacklisted"}
STRENGTHS = {"regex_match": 1.0, "direct_match": 0.9, "weak_fallback": 0.55, "not_found": 0.0}
LOW_CONFIDENCE = 60
MRZ_COUNTRIES = ("ARE", "USA", "GBR", "IND", "CAN", "AUS", "DEU", "FRA", "NGA", "EXA")
RISK_WEIGHTS = {"validation": 0.25, "db_status": 0.30, "tampering": 0.30, "face_match": 0.15}
RISK_LABELS = {"validation": "Document validation", "db_status": "Registry check", "tampering": "Tampering analysis", "face_match": "Face match"}
STATUS_RISK = {"valid": 0.0, "not found": 35.0, "expired": 65.0, "blacklisted": 100.0, "error": 50.0}
BANDS = (("LOW", 0, 20), ("MEDIUM", 21, 50), ("HIGH", 51, 75), ("CRITICAL", 76, 100))
TAMPERING_WEIGHTS = {"photo_substitution": 0.35, "text_manipulation": 0.30, "stamp_forgery": 0.20, "metadata": 0.15}
EDITORS = (
    "photoshop", "gimp", "snapseed", "lightroom", "pixlr", "picsart", "canva", "affinity photo", "paint.net", "illustrator", "capture one", "photopea", "inkscape",
)
UPLOAD_TYPES = ("jpeg", "jpg", "png")
UPLOAD_MB = 10.0
GENESIS = "0" * 64
