"""Fixed values used by the analyses. They must stay exactly as written for results to match.

Nothing here is derived: these are the category rules, lookup lists and labels of the
original analysis, kept verbatim and in their original order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: incident-description rules (one pattern per line, as written in the analysis).
# Ordered; the first rule whose pattern occurs anywhere in the text (case-insensitive,
# no word boundaries) wins. Anything else, including NULL, is DEFAULT_CATEGORY.
# ---------------------------------------------------------------------------
CRIME_RULES: tuple[tuple[str, str], ...] = (
    ("Violent Crime", "ASSAULT|ROBBERY|HOMICIDE|RAPE|SEXUAL|KIDNAPPING|ENDANGERMENT|MENACING|STRANGULATION|OBSTR BREATH/CIRCUL|AGGRAVATED HARASSMENT|MAKING TERRORISTIC THREAT|FORCIBLE TOUCHING|MURDER|COERCION|SODOMY|STALKING"),
    ("Property Crime", "BURGLARY|LARCENY|THEFT|FORGERY|FRAUD|ARSON|MISCHIEF|GRAFFITI|STOLEN PROPERTY|UNAUTHORIZED USE VEHICLE|BURGLARS TOOLS"),
    ("Drug/Alcohol", "CONTROLLED|DRUG|CANNABIS|ALCOHOL|IMPAIRED|MARIJUANA|POSS METH|SYNTHETIC"),
    ("Weapons/Explosives", "WEAPON|FIREWORKS|EXPLOSIVE|CRIM POS WEAP|FIREARMS"),
    ("Public Order/Admin", "TRESPASS|DISORDERLY|LOITERING|TRAFFIC|BRIBERY|PUBLIC|CODE|HEALTH|BAIL JUMPING|ESCAPE|IMPRISONMENT|CONTEMPT|NUISANCE|OBSCENITY|FUGITIVE|UNLICENSED OPERATOR|RADIO DEVICES|APPEARANCE TICKET|GENERAL BUSINESS LAW|NY STATE LAWS|NYS|NYC UNCLASSIFIED"),
    ("Sex Crimes", "PROSTITUTION|PATRONIZING|PROMOTING|LICENSED PREMISES|COMPULSORY|SEX CRIMES|INCEST|LURING A CHILD"),
    ("Animal Crimes", "ANIMAL|TORTURE/INJURE|NEGLECT/POISON|CONFINING ANIMAL|CAUSE SPI/KILL|ABANDON ANIMAL"),
    ("Traffic", "RECKLESS DRIVING|SPEEDING|FAIL TO SIGNAL|SEAT BELTS|IMPROPER LIGHTS|ONE WAY STREET"),
    ("Financial/White Collar", "MONEY LAUNDERING|SALE|SALES OF PRESCRIPTION|UNAUTH. SALE"),
)
DEFAULT_CATEGORY = "Other"

# FIXED VALUES: short display names for two long categories (pass-through for the rest).
CATEGORY_SHORT_NAMES: dict[str, str] = {
    "Financial/White Collar": "Financial",
    "Public Order/Admin": "Public/Admin",
}

# FIXED VALUES: sex codes to labels (anything else unchanged, NULL stays NULL).
SEX_LABELS: dict[str, str] = {"M": "Male", "F": "Female"}

# FIXED VALUES: county names kept for the base map, and their borough aliases.
BOROUGH_COUNTIES: tuple[str, ...] = ("New York", "Kings", "Queens", "Bronx", "Richmond")
BOROUGH_ALIASES: dict[str, str] = {
    "New York": "Manhattan",
    "Kings": "Brooklyn",
    "Richmond": "Staten Island",
}

# FIXED VALUES: road classes and the bounding box (xmin, ymin, xmax, ymax) of the base map.
ROAD_CLASSES: tuple[str, ...] = ("motorway", "trunk", "primary", "secondary", "tertiary")
CITY_BBOX: tuple[float, float, float, float] = (-74.259, 40.477, -73.700, 40.917)

# FIXED VALUES: map viewport (xmin, xmax, ymin, ymax) and the point-size range.
MAP_VIEW: tuple[float, float, float, float] = (-74.25, -73.7, 40.5, 40.92)
POINT_SIZE_RANGE: tuple[float, float] = (2.0, 8.0)

# FIXED VALUES: records excluded from the race share after the percentages are computed.
RACE_EXCLUDED_AFTER_SHARE: tuple[str, ...] = ("UNKNOWN", "AMERICAN INDIAN/ALASKAN NATIVE")

# FIXED VALUES: colour scales.
CATEGORY_COLOURS: dict[str, str] = {
    "Violent Crime": "#ff0000",
    "Property Crime": "#ffe100",
    "Public Order/Admin": "#000000",
}
SEX_COLOURS: dict[str, str] = {"Male": "#abc4ff", "Female": "#fcb0f3"}
RACE_PALETTE: tuple[str, ...] = ("#f72585", "#7209b7", "#3a0ca3", "#4361ee", "#4cc9f0")
AGE_COLOURS: dict[str, str] = {
    "<18": "#9b5de5",
    "18-24": "#f15bb5",
    "25-44": "#fee440",
    "45-64": "#00bbf9",
    "65+": "#cccccc",
}
LAYER_COLOURS: dict[str, str] = {"Weapon Arrests": "blue", "Shooting Incidents": "red"}

# FIXED VALUES: English month abbreviations, January first.
MONTH_ABBREVIATIONS: tuple[str, ...] = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)

# FIXED VALUES: short-scale suffixes and their thresholds, smallest first.
SHORT_SCALE: tuple[tuple[float, str], ...] = ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T"))
