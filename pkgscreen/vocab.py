"""Word lists, lookup tables and patterns that decide results.

Patterns are written in the subset shared by Java and RE2, so the Spark jobs
and the SQL checks read the same text. All are meant to be used with ``(?i)``
unless the name ends in ``_CS``.
"""

# ---------------------------------------------------------------- fixed values
# declarations, in extraction order
FIELDS = [
    "mrp", "product_name", "net_quantity", "manufacturer", "packer", "importer",
    "manufacturing_date", "packing_date", "best_before", "batch_number",
    "consumer_care", "country_of_origin", "brand",
]
ENTITY_FIELDS = ["manufacturer", "packer", "importer"]

# white space as Unicode defines it
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
# the same, one by one, as a SQL literal writes them
WS_CHARS = "".join(rf"\u{c:04x}" for c in (*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000))

# ------------------------------------------- fixed values: reject line classes
REJECT = {
    "fssai": r"fssai|lic\.?\s*no",
    "pin_code": r"pin\s*:?\s*\d{6}|\b\d{6}\b.*india",
    "phone": r"\+?\d{1,2}[-\s]?\d{3,4}[-\s]?\d{3,4}[-\s]?\d{0,4}",
    "barcode": r"^\d{8,14}$",
    "nutrition": r"(total\s*(fat|protein|cholesterol|carbohydrate|sugar|fiber)|saturated|trans|sodium|potassium|calcium|iron|vitamin|energy|calories|nutritional)",
    "batch": r"batch\s*(no|number)|lot\s*(no|number)|b\.?no",
}

# ------------------------------------------------- fixed values: retail price
MRP_KEYWORD = r"\bm\.?r\.?p\.?\b|\bmax\.?\s*retail\s*price\b|\bunit\s*selling\s*price\b|\bmax\.?\s*retail\s*pr\b"
PRICE_VALUE = r"(?:rs\.?|₹|inr)?\s*[\.:]?\s*(\d{1,5}(?:\.\d{1,2})?)"
PRICE_LONG_NUMBER = r"\b\d{6,14}\b"
PRICE_WORD = r"(?:rs|₹|mrp|price)"
PRICE_UNIT_SUFFIX = r"\d+\.?\d*\s*(mg|g|kg|ml|l|kcal|cal|mcg|%)(?:\s|$)"
PRICE_NEIGHBOUR_SKIP = r"(nutrition|ingredient|total\s*fat|protein|carbohydrate|calories|%)"
PRICE_TAX = r"(inclusive of all taxes|incl\.?\s*of\s*all taxes|\(incl\b|unit\s*sale|all\s*taxes\b)"
PRICE_ODD = r"m\.?r\.?p[^\d]*(\d{1,5}(?:\.\d{1,2})?)"
PRICE_ODD_START = r"\bm\.?r\.?p"
PRICE_MIN, PRICE_MAX = 1, 50000

# ------------------------------------------------- fixed values: net quantity
QTY_LABEL = r"\bnet\s*(?:wt\.?|weight|wt|qty|quantity)\b|\bnet\s*wt\b|\bquantity\s*when\s*packed\b"
QTY_VALUE = r"(\d+(?:\.\d+)?)\s*(g|gm|grams?|kg|ml|l|liters?|pcs?|pieces?)\b"
QTY_VALUE_SHORT = r"(\d{2,4})\s*(g|gm|kg|ml|l)\b"
QTY_WORD = r"net|qty|weight|wt"
QTY_NUTRITION_ROW = r"(total\s*fat|protein|carbohydrate|calories|energy|sodium|cholesterol|sugar|fiber)"
QTY_NUTRITION_WORDS = [
    "total fat", "saturated fat", "trans fat", "cholesterol", "sodium",
    "potassium", "total carbohydrate", "dietary fiber", "sugar", "protein",
    "calcium", "iron", "vitamin", "energy", "calories", "nutritional",
    "nutrition facts", "per 100", "serving size", "amount per",
]

# ------------------------------------------------------ fixed values: entities
ENTITY_KEYWORDS = {
    "manufacturer": [
        r"\bmanufactured by\b", r"\bmfg\.?\s*by\b", r"\bmanufacturer\b",
        r"\bmarketed by\b", r"\bmanufactured & marketed by\b",
        r"\bmanufactured and marketed by\b", r"\bmfd\.?\s*by\b", r"\bmkt\.?\s*by\b",
    ],
    "packer": [
        r"\bpacked by\b", r"\bpkd\.?\s*by\b", r"\bpacker\b",
        r"\bpacked & marketed by\b", r"\bpacked and marketed by\b",
        r"\bpacked on\b", r"\bdate of packing\b",
    ],
    "importer": [r"\bimported by\b", r"\bimp\.?\s*by\b", r"\bimporter\b"],
}
COMPANY_WORDS = [
    "ltd", "pvt", "private", "limited", "corp", "corporation", "inc", "llc",
    "foods", "beverages", "industries", "enterprise", "gruh", "udhyog", "sakhi", "mandal",
]
COMPANY_NUTRITION_WORDS = [
    "protein", "fat", "carbohydrate", "calories", "energy", "sodium", "cholesterol",
    "sugar", "fiber", "vitamin", "iron", "calcium", "proprietary", "food:", "foods,",
]
ENTITY_REJECT = (
    r"fssai|fssat|lic\.?\s*no|licence|license|see\s+(?:the\s+)?(?:first|base|bottom|lid|back)"
    r"|base\s+of\s+can|on\s+the\s+base|expiry|use\s*by|best\s*before|batch|lot\s*no"
    r"|isi\s*mark|is\s*:|cm/l|address|see\s+label"
)
ENTITY_NUTRITION = r"(nutrition|total fat|protein|carbohydrate|calories|energy|sodium|cholesterol)"
NAME_CONTINUATION = r"^(?:private|pvt\.?|ltd\.?|limited|llp|inc\.?|co\.?,?|company|and|&|india|enterprises?)\.?$"

# --------------------------------------------------------- fixed values: dates
DATE_LABELS = {
    "manufacturing_date": r"\bmfg\.?\s*(?:date)?\b|\bmfd\.?\s*(?:date)?\b|\bmanufacturing\s*(?:date)?\b|\bmanufactured\s*(?:date|on)?\b|\bmfd\b",
    "packing_date": r"\bpkd\.?\s*(?:date|on)?\b|\bpacked\s*(?:date|on)?\b|\bpacking\s*(?:date)?\b|\bdate of packing\b",
    "best_before": r"\bbest before\b|\buse\s*by\b|\buseby(?:[^a-z]|$)|\bexp\.?\s*(?:date)?\b|\bexpiry\b|\bbest before date\b",
}
DATE_OTHER_LABELS = {
    "manufacturing_date": r"\b(best\s*before|use\s*by|exp\.?|expiry)\b",
    "packing_date": r"\b(best\s*before|use\s*by|exp\.?|expiry)\b",
    "best_before": r"\b(mfg|mfd|manufactur\w*|pkd|pack\w*)\b",
}
DATE_VALUES = [
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    r"\b(\d{1,2}[A-Za-z]{3}\d{2,4})\b",
    r"\b(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4})\b",
    r"\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\-]*\d{2,4})\b",
    r"\b(\d{1,2}[/\-.]\d{4})\b",
]
DATE_EMBEDDED_CS = r"\b(\d{1,2}[A-Za-z]{3}\d{2,4})\b"
DATE_ADDRESS_WORDS = [
    "road", "street", "area", "industrial", "gidc", "india", "pin", "dist",
    "district", "po:", "p.o.",
]
DATE_BATCH_LINE = r"\b(batch no|b\.no|bno|batch|lot no|lot)\b"
INSTRUCTION = (
    r"feedback|quer(?:y|ies)|complaint|mention|write to|call us|"
    r"consumer care|customer care|indicating"
)

# --------------------------------------------------------- fixed values: batch
BATCH_VALUES = [
    r"\bbatch\s*(?:no\.?|number)?\s*:?\s*([A-Za-z0-9\-/]+)",
    r"\bb\.?\s*no\.?\s*:?\s*([A-Za-z0-9\-/]+)",
    r"\blot\s*(?:no\.?|number)?\s*:?\s*([A-Za-z0-9\-/]+)",
]
BATCH_NOT_CODES = [
    "no", "ne", "number", "lot", "batch", "and", "the", "for", "of", "in",
    "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our",
    "out", "day", "get", "has", "him", "his", "how", "man", "new", "now", "old",
    "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she",
    "too", "use",
]
BATCH_SHAPE_CS = r"^[A-Za-z0-9][A-Za-z0-9\-/]{1,11}$"
BATCH_QTY = r"\b\d+\s*(?:mg|g|gm|kg|ml|l|kcal|cal|mcg|pcs)\b"
BATCH_DATE_CS = r"\b\d{1,2}[A-Za-z]{3}\d{2,4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
BATCH_NUTRITION = (
    r"^(?:protein|fats?|carbs?|carbohydrates?|sugars?|fibre|fiber|sodium|"
    r"energy|calcium|iron|vitamins?\w*|cholesterol|moisture|ash|trans|"
    r"saturated|kcal|calories)$"
)

# ------------------------------------------------- fixed values: consumer care
CARE_WORDS = [
    "customer care", "consumer care", "toll free", "helpline", "contact", "call us",
    "for feedback", "for queries", "for complaints", "write to us", "feedback",
    "complaints", "queries", "consumer relations", "customer relations",
    "relations representative", "consumer cell", "contact us", "consumer services",
]
CARE_PHONE_CS = (
    r"(?:\+?91[-\s]?)?(?:\d{5}[-\s]?\d{5}|\d{4}[-\s]?\d{3}[-\s]?\d{4}"
    r"|\d{3}[-\s]?\d{4}[-\s]?\d{4}|\d{3}[-\s]?\d{3}[-\s]?\d{4}"
    r"|\d{4}[-\s]?\d{2}[-\s]?\d{4}|\d{5}[-\s]?\d{3}[-\s]?\d{3})"
)
EMAIL_CS = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CARE_LOCAL_PARTS = [
    "info", "care", "support", "contact", "feedback", "helpdesk", "help", "customercare",
]
CARE_DOMAIN_WORDS = [
    "care", "support", "help", "service", "feedback", "customercare", "consumer",
]

# -------------------------------------------------------- fixed values: origin
ORIGIN_VALUES = [
    r"\bcountry of origin\s*:?\s*([A-Za-z\s]+)",
    r"\bproduct of\s+([A-Za-z\s]+)",
    r"\bmade in\s+([A-Za-z]+(?:\s+[A-Za-z]+)?)\b",
]
ORIGIN_COUNTRIES = [
    "india", "china", "usa", "america", "united states", "uk", "united kingdom",
    "thailand", "vietnam", "bangladesh", "nepal", "sri lanka", "pakistan",
    "malaysia", "singapore", "indonesia", "japan", "korea", "germany",
    "france", "italy", "spain", "netherlands", "australia", "canada",
    "brazil", "mexico", "uae", "dubai", "saudi arabia", "turkey",
]

# ---------------------------------------------- fixed values: name and brand
NAME_SKIP = (
    r"m\.?r\.?p|retail\s*price|unit\s*sale|taxes|incl\b|usp\b"
    r"|net\s*(wt|weight|qty|quant)"
    r"|mfg|mfd|manufactur|facture|packed|marketed|mkt\.?\s*by|batch|lot\b"
    r"|\bbrand\b"
    r"|best\s*before|use\s*by|useby|exp|licen|lic\.?\s*no|fssa"
    r"|ingredient|nutrition|energy|protein|fat\b|carbohydrate|sodium"
    r"|calcium|vitamin|sugar|cholesterol|serving|kcal|per\s*100"
    r"|consumer|customer|helpline|toll|call\s*us|contact|email|phone"
    r"|feedback|address|pin\b|road|street"
    r"|industrial|estate|plot\b|product\s*of|made\s*in|country\s*of\s*origin"
    r"|store\b|keep\b|warning|contains|allergen|see\s+(the\s+)?(base|neck|first)"
    r"|base\s*of\s*can|qr\s*code|bar\s*code|smart\s*app|letter\b"
    r"|maharashtra|gujarat|haryana|karnataka|tamil|kerala|andhra|telangana"
    r"|bengal|rajasthan|punjab|pradesh|bihar|odisha|assam|delhi|mumbai"
    r"|chennai|kolkata|hyderabad|bangalore|bengaluru|ahmedabad|surat"
    r"|jaipur|lucknow|indore|nagpur|gurugram|india\b|www|\.com"
)
BRAND_LABEL = r"\b(?:brand(?:\s*name)?|marketed\s*(?:by|under)|a\s+brand\s+of)\b\s*[:\-]?\s*(.*)"
# printed mark, bracketed mark, or TM right after a letter
TRADEMARK_CS = r"[™®©]|\((?i:tm|r|c)\)|(?<=[A-Za-z])\s?TM\b"
BRAND_SKIP = (
    r"m\.?r\.?p|retail\s*price|unit\s*sale|taxes|incl\b"
    r"|net\s*(wt|weight|qty|quant)"
    r"|mfg|mfd|manufactur|facture|packed|pkd|batch|lot\b"
    r"|best\s*before|use\s*by|useby|\bexp\b|licen|lic\.?\s*no|fssa"
    r"|ingredient|nutrition|energy|protein|fat\b|carbohydrate|sodium"
    r"|calcium|vitamin|sugar|cholesterol|serving|kcal|per\s*100"
    r"|consumer|customer|helpline|toll|call\s*us|contact|email|phone"
    r"|feedback|address|pin\b|road|street|plot\b|estate|industrial"
    r"|product\s*of|made\s*in|country\s*of\s*origin"
    r"|maharashtra|gujarat|haryana|karnataka|tamil|kerala|andhra|telangana"
    r"|bengal|rajasthan|punjab|pradesh|bihar|odisha|assam|delhi|mumbai"
    r"|chennai|kolkata|hyderabad|bangalore|bengaluru|ahmedabad|surat"
    r"|jaipur|lucknow|indore|nagpur|gurugram|\bindia\b"
    r"|store\b|keep\b|warning|contains|allergen|see\s+(the\s+)?(base|neck|first)"
    r"|base\s*of\s*can|qr\s*code|bar\s*code|www|\.com|@"
)
ENTITY_SUFFIX = (
    r"\b(pvt|private|ltd|limited|llp|inc|corp|corporation|co\.?|company|"
    r"industries|enterprises|foods?\s+pvt|&\s*sons)\b"
)

# ------------------------------------------------ fixed values: evidence pool
# still-missing fields are filled in this order from candidates of this kind
FIELD_KINDS = [
    ("mrp", "currency"), ("net_quantity", "quantity"), ("manufacturing_date", "date"),
    ("packing_date", "date"), ("best_before", "date"), ("batch_number", "code"),
    ("consumer_care", "contact"), ("manufacturer", "entity"), ("packer", "entity"),
    ("importer", "entity"), ("country_of_origin", "country"),
]
BASE_FIELDS = ["mrp", "batch_number", "manufacturing_date", "packing_date", "best_before"]
ANCHOR_FIELDS = ["consumer_care", "manufacturer", "packer", "importer", "country_of_origin"]
LABEL_ANCHORS = {
    "consumer_care": r"care|helpline|toll\s*free|call\s*us|relations\s*representative|contact|quer|feedback|complaint",
    "manufacturer": r"manufactur|mfg\.?\s*by|marketed\s*by|brand\s*owned",
    "packer": r"pack(?:ed|er)|pkd",
    "importer": r"import",
    "country_of_origin": r"country\s*of\s*origin|product\s*of|made\s*in|origin",
}
CAND_CURRENCY = r"(?:₹|rs\.?|inr)\s*\.?\s*:?\s*(\d{1,5}(?:\.\d{1,2})?)"
CAND_QUANTITY = r"(\d+(?:\.\d+)?)\s*(kg|g|gm|grams?|ml|l|litres?|liters?|pcs?|pieces?)\b"
CAND_DATES_CS = [
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    r"\b(\d{1,2}[A-Za-z]{3}\d{2,4})\b",
    r"\b(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4})\b",
    r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\-]*\d{2,4})\b",
]
CAND_PHONE_CS = (
    r"(?:\+?91[-\s]?)?(?:\d{5}[-\s]?\d{5}|\d{4}[-\s]?\d{3}[-\s]?\d{4}"
    r"|\d{3}[-\s]?\d{4}[-\s]?\d{4}|\d{3}[-\s]?\d{3}[-\s]?\d{4}"
    r"|\d{4}[-\s]?\d{2}[-\s]?\d{4})"
)
CAND_STANDARD_MARK = r"cm/l|isi|is\s*:"
ADDRESS_STRONG = (
    r"\b(road|street|plot\b|survey\b|gidc|industrial|estate|district|dist\b"
    r"|village|taluka|mandal|state\b|pin\b|\d{6}\b|p\.?o\.?\s*box)"
)
ADDRESS_WEAK = (
    r"\b(maharashtra|gujarat|haryana|karnataka|tamil\s*nadu|kerala|andhra"
    r"|telangana|west\s*bengal|rajasthan|punjab|uttar\s*pradesh|madhya"
    r"|bihar|odisha|assam|delhi|mumbai|chennai|kolkata|hyderabad|bangalore"
    r"|bengaluru|ahmedabad|surat|jaipur|lucknow|indore|nagpur|gurugram"
    r"|india\b)"
)
CAND_COMPANY = (
    r"\b(ltd|pvt|private|limited|corp|corporation|inc|llc|foods|beverages"
    r"|industries|enterprise)"
)
CAND_CODE_CS = r"^[A-Z0-9\-/]{3,12}$"
CAND_LICENCE = r"lic|fssai|licence|license"
CAND_NUTRITION = (
    r"(total\s*(fat|protein|cholesterol|carbohydrate|sugar|fiber)|saturated|trans"
    r"|sodium|potassium|calcium|iron|vitamin|energy|calories|nutritional|per\s*100"
    r"|serving|kcal|carbohydrate|rda)"
)
CAND_ENTITY_POINTER = r"see\s+(the\s+)?(base|first|bottom)|base\s+of\s+can"
DATE_TEXT_USE_BY = r"use\s*by|useby|exp\.?\b|expiry|best\s*before"
DATE_TEXT_MADE = r"mfg|mfd|manufactur|pkd|packed|packing"
CAND_COUNTRIES = [
    "india", "usa", "united states", "uk", "united kingdom", "germany",
    "thailand", "malaysia", "china", "japan", "korea", "australia", "canada",
    "uae", "dubai", "singapore", "indonesia", "vietnam", "sri lanka",
    "bangladesh", "nepal", "bhutan", "pakistan", "russia", "italy", "france",
    "spain", "switzerland", "netherlands", "denmark", "new zealand", "brazil",
    "mexico", "turkey", "israel", "ireland", "poland", "belgium", "sweden",
    "norway", "finland", "greece", "portugal", "south africa", "nigeria",
    "kenya", "egypt", "philippines", "taiwan", "hong kong",
]
POINTER_OF = (
    r"see\s+(?:the\s+)?(?:first\s+)?(?:letter|character|no\.?|number|code|date)?"
    r"[\s\S]{0,40}?(base|bottom|lid|cap|neck|back|front|top)\s+of\s+(?:the\s+)?"
    r"(can|bottle|pack|package|carton|tin|jar)"
)
POINTER_PLACE = r"see\s+(?:the\s+)?(neck|base|bottom|lid|cap|top|back|front)\b"
POINTER_ON = (
    r"\b(?:on|at)\s+the\s+(base|bottom|lid|cap|neck)\s+of\s+(?:the\s+)?"
    r"(can|bottle|pack|package|carton|tin|jar)"
)
POINTER_CONTINUES = (
    r"^(mfd|mfg|use\s*by|useby|net\s*quant|batch|lot|exp|best\s*before|mrp"
    r"|unit\s*sale|date|no\.|lic)"
)
POINTER_HINTS = [
    (r"expir|use\s*by|useby|best\s*before", "best_before"),
    (r"mfg|mfd|manufactur", "manufacturing_date"),
    (r"batch|lot|no\.,", "batch_number"),
    (r"unit\s*sale|mrp|price|taxes|usp", "mrp"),
    (r"net\s*quant", "net_quantity"),
]
POINTER_CONTAINER = r"can|bottle|tin|jar|neck|lid|cap"
BASE_PLACES = ["base", "bottom", "lid", "cap", "neck"]
ENTITY_LABEL_PREFIX = (
    r"^(?:mfd|mfg|mkt|manufactured|marketed|packed|imported|brand\s*owned"
    r"|and\s*mkt)\.?\s*(?:by|and)?\s*[:\-]?\s*"
)

# ------------------------------------------------------ fixed values: validators
UNIT_VALUE = r"(\d+(?:\.\d+)?)\s*(kg|g|gm|gram|grams|l|ml|litre|liter|litres|liters|pcs|pieces|nos|units?)\b"
PRICE_NUMBER = r"(\d{1,5}(?:\.\d{1,2})?)"
STANDARD_QTY = r"(\d+(?:\.\d+)?)\s*(kg|g|gm|ml|l|cm|m|pcs?)\b"
MONTH_YEAR = [
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{1,2}[/\-.]\d{4}",
    r"\d{1,2}[A-Za-z]{3}\d{2,4}",
    r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}",
    r"[A-Za-z]{3,9}\s*[\-]?\s*\d{2,4}",
]
MONTH_WORD = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|month)"
DAY_MONTH_YEAR = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
WORDING_ABBREVIATIONS = {
    "minimum": [r"\bmin\b", r"\bmin\."],
    "not less than": [r"\bn\.?l\.?t\b", r"\bnot\s*<\s*\d"],
    "average": [r"\bavg\b", r"\bavg\."],
    "approximately": [r"\bapprox\b", r"\bapprox\."],
    "about": [r"\babt\b"],
}
# units and the values at which another unit is required
UNIT_LIMITS = [
    ("g", ">=", 1000), ("gm", ">=", 1000), ("kg", "<", 1), ("ml", ">=", 1000),
    ("l", "<", 1), ("cm", ">=", 100), ("m", "<", 1),
]
LANGUAGE_FIELDS = [
    "mrp", "net_quantity", "product_name", "manufacturer", "manufacturing_date",
    "consumer_care", "country_of_origin",
]
BASE_FIELDS_STATUTORY = BASE_FIELDS + ["net_quantity"]

# ------------------------------------------------- fixed values: rule categories
DECLARATION_CATEGORIES = [
    "manufacturer_details", "commodity_identity", "net_quantity", "date_declaration",
    "mrp", "consumer_contact",
]
PARTIAL_CATEGORIES = ["mrp", "net_quantity"]
SCOPE_NA_TYPES = [
    "SCHEDULE_LOOKUP", "VISUAL_RULE", "CONDITIONAL_DECLARATION_CHECK",
    "MEASUREMENT_TABLE_LOOKUP", "LOCATION_AND_SPACING", "CONDITIONAL_WRAPPER_CHECK",
    "MEASUREMENT_RULE", "CONDITIONAL_COMPLIANCE_GATE", "ADVERTISEMENT_CHECK",
    "PACKAGE_COMPLIANCE_GATE", "CONDITIONAL_CONTAINER_RULE", "CONDITIONAL_FIELD_PRESENCE",
    "EXEMPTION_LOOKUP",
]
SCOPE_NA_RULES = ["PC2011-R24-001", "PC2011-R25-001", "PC2011-R18-001", "PC2011-R31-001"]
HANDLER_CATEGORIES = [
    "manufacturer_details", "commodity_identity", "net_quantity", "quantity_unit",
    "date_declaration", "mrp", "consumer_contact", "quantity_language", "unit_format",
    "language", "declaration_legibility",
]
CATEGORY_BUCKETS = {
    "package_declarations": "mandatory_declarations",
    "manufacturer_details": "mandatory_declarations",
    "commodity_identity": "mandatory_declarations",
    "net_quantity": "mandatory_declarations",
    "date_declaration": "mandatory_declarations",
    "mrp": "mandatory_declarations",
    "consumer_contact": "mandatory_declarations",
    "container_declaration": "mandatory_declarations",
    "count_declaration": "mandatory_declarations",
    "multi_component_package": "mandatory_declarations",
    "outer_wrapper": "mandatory_declarations",
    "quantity_definition": "mandatory_declarations",
    "quantity_unit": "formatting",
    "unit_format": "formatting",
    "quantity_language": "formatting",
    "quantity_dimensions": "formatting",
    "language": "formatting",
    "sticker_compliance": "formatting",
    "standard_pack_size": "formatting",
    "dimensions": "formatting",
    "display_legibility": "readability",
    "declaration_location": "readability",
    "declaration_legibility": "readability",
    "declaration_readability": "readability",
    "dealer_sale": "other",
    "wholesale_package": "other",
    "export_package": "other",
    "exemptions": "other",
    "advertisement": "other",
}
BUCKETS = ["mandatory_declarations", "formatting", "readability", "other"]
SEVERITY_WEIGHTS = {"CRITICAL": 3.0, "HIGH": 2.0, "MEDIUM": 1.5, "LOW": 1.0}
SEVERITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
STATUS_CREDIT = {"PASS": 1.0, "MANUAL_REVIEW": 0.5, "FAIL": 0.0}
GRADES = [(90.0, "A"), (75.0, "B"), (60.0, "C"), (40.0, "D"), (0.0, "E")]
DECLARED_FIELDS = {
    "retail_sale_price": ["mrp"],
    "common_or_generic_name": ["product_name"],
    "commodity_identity": ["product_name"],
    "net_quantity": ["net_quantity"],
    "net_quantity_unit": ["net_quantity"],
    "retail_package_count_or_wholesale_net_quantity": ["net_quantity"],
    "manufacturer_name": ["manufacturer"],
    "manufacturer_address": ["manufacturer"],
    "manufacturer_or_importer_or_packer": ["manufacturer", "packer", "importer"],
    "manufacture_month_year": ["manufacturing_date", "packing_date"],
    "consumer_contact_name": ["consumer_care"],
    "consumer_contact_address": ["consumer_care"],
    "consumer_contact_phone": ["consumer_care"],
}
CATEGORY_FIELDS = {
    "mrp": ["mrp"],
    "commodity_identity": ["product_name"],
    "net_quantity": ["net_quantity"],
    "quantity_unit": ["net_quantity"],
    "quantity_language": ["net_quantity"],
    "unit_format": ["net_quantity"],
    "quantity_definition": ["net_quantity"],
    "count_declaration": ["net_quantity"],
    "date_declaration": ["manufacturing_date", "packing_date", "best_before"],
    "manufacturer_details": ["manufacturer", "packer", "importer"],
    "consumer_contact": ["consumer_care"],
}
REVIEW_FIELDS = {
    "mrp": ["mrp"],
    "commodity_identity": ["product_name"],
    "net_quantity": ["net_quantity"],
    "quantity_unit": ["net_quantity"],
    "quantity_language": ["net_quantity"],
    "unit_format": ["net_quantity"],
    "date_declaration": ["manufacturing_date", "packing_date"],
    "manufacturer_details": ["manufacturer", "packer", "importer"],
    "consumer_contact": ["consumer_care"],
    "declaration_legibility": ["mrp", "net_quantity"],
    "language": [],
}

# ---------------------------------------------- fixed values: commodity classes
STRONG_WEIGHT, WEAK_WEIGHT = 3, 1
COMMODITY = [
    ("food", [
        r"\bfssai\b", r"\blic\.?\s*no\b.*\d{14}", r"\bnutrition(al)?\s*(information|facts)\b",
        r"\bingredients?\b", r"\bveg\b|\bnon[- ]?veg\b", r"\ballergen",
        r"\benergy\s*\(?k?cal", r"\bbest\s*before\b.*\bconsum",
    ], [
        r"\bsnack|biscuit|namkeen|bhujia|chips|wafer|noodle|pasta|atta|flour",
        r"\bspice|masala|pickle|jam|honey|sauce|ketchup|chocolate|candy",
        r"\brice\b|\bdal\b|\bpulse|\bsugar\b|\bsalt\b|\btea\b|\bcoffee\b",
        r"\bprotein|carbohydrate|saturated\s*fat|trans\s*fat|sodium",
    ]),
    ("beverage", [
        r"\bcarbonated\b", r"\bpacked?\s*drinking\s*water\b", r"\bmineral\s*water\b",
        r"\bfruit\s*(juice|drink|beverage)\b", r"\bready\s*to\s*(drink|serve)\b",
    ], [
        r"\bjuice\b|\bdrink\b|\bbeverage\b|\bsoda\b|\bcola\b|\bwater\b",
        r"\bserve\s*chilled\b|\bshake\s*well\b|\bnot?\s*added\s*sugar\b",
        r"\b\d+\s*ml\b|\b\d+(\.\d+)?\s*l(itre|tr)?\b",
    ]),
    ("cosmetic", [
        r"\bfor\s*external\s*use\s*only\b", r"\bcosmetic\b",
        r"\bmfg\.?\s*lic(ence|ense)?\s*no\b", r"\bdrugs?\s*(and|&)\s*cosmetics?\s*act\b",
    ], [
        r"\bshampoo|soap|lotion|cream\b|\bmoisturis|conditioner|deodorant",
        r"\bperfume|talc|face\s*wash|hair\s*oil|toothpaste|sunscreen|spf\b",
    ]),
    ("drug", [
        r"\bschedule\s*h1?\b", r"\bprescription\s*only\b",
        r"\bto\s*be\s*sold\s*by\s*retail\s*on\s*the\s*prescription\b",
        r"\bdrugs?\s*(and|&)\s*cosmetics?\s*rules?\b",
    ], [
        r"\btablet|capsule|syrup|ointment|dosage|mg\b\s*/\s*ml|\bip\b|\bbp\b",
        r"\bstore\s*below\s*\d+\s*c\b|\bkeep\s*out\s*of\s*reach\s*of\s*children\b",
    ]),
    ("household", [
        r"\bnot\s*for\s*human\s*consumption\b", r"\bharmful\s*if\s*swallowed\b",
    ], [
        r"\bdetergent|bleach|disinfect|floor\s*clean|dishwash|toilet\s*clean",
        r"\bphenyl|insecticid|repellent|freshener|polish\b",
    ]),
    ("textile", [
        r"\bcotton\s*\d{1,3}\s*%", r"\bmachine\s*wash\b", r"\bdo\s*not\s*bleach\b",
    ], [r"\bpolyester|viscose|fabric|garment|size\s*:\s*(s|m|l|xl|xxl)\b"]),
    ("electrical", [
        r"\bbis\s*registration\b", r"\be-?waste\b", r"\b\d{2,3}\s*v\s*[~/]\s*\d{2}\s*hz\b",
    ], [r"\bwatt\b|\bvoltage\b|\bwarranty\b|\bmodel\s*no\b|\bserial\s*no\b|\bisi\b"]),
]
CATEGORY_RULE_SCOPE = {
    "multi_component_package": ["cosmetic", "food", "household", "electrical"],
    "container_declaration": ["food", "beverage", "household"],
    "count_declaration": ["food", "household", "electrical", "textile"],
    "quantity_dimensions": ["textile", "household"],
    "dimensions": ["textile", "household", "electrical"],
    "outer_wrapper": ["food", "cosmetic", "electrical"],
    "standard_pack_size": ["food", "beverage", "household"],
}

# --------------------------------------------------- fixed values: retrieval
REG_STOPWORDS = [
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but",
    "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "may",
    "not", "of", "on", "or", "other", "otherwise", "shall", "should", "such",
    "than", "that", "the", "their", "there", "these", "this", "those", "to",
    "under", "upon", "was", "were", "which", "while", "who", "with", "would",
]
REG_TOKEN = r"[a-z0-9]+"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
NGRAM, VECTOR_DIM = 3, 512
BM25_K1, BM25_B = 1.5, 0.75
KEYWORD_SHARE, VECTOR_SHARE = 0.65, 0.35
INFORMATIONAL = ["what is", "explain", "tell me", "describe", "overview"]

# --------------------------------------------------- fixed values: admission
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/webp", "image/bmp", "image/tiff"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]
BATCH_EXTENSIONS = ["jpg", "jpeg", "png", "bmp"]
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MAX_SURFACES = 6
