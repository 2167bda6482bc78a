"""Fixed values that results depend on."""

# Earth radii in metres: labelling uses the equatorial radius, scoring the mean one.
LABEL_RADIUS_M = 6378137.0
SCORE_RADIUS_M = 6371000.0

# WGS84 flattening, and the convergence bound of the latitude iteration.
WGS84_FLATTENING = 1.0 / 298.257223563
FIXED_POINT_ROUNDS = 5
FIXED_POINT_PRECISION = 2.220446049250313e-16

# Scoring and losses.
SCORE_MAX = 5000.0
SCORE_DECAY_KM = 1492.7
LABEL_SMOOTHING_KM = 65.0
REFINE_TEMPERATURE = 1.6
REFINE_MAX_KM = 1000.0
MISSING_LOGIT = -100000.0

# Geocell thresholds.
MIN_CELL_POINTS = 10
MAX_CELL_POINTS = 67
MAX_CLUSTER_POINTS = 10
CLUSTER_MIN_POINTS = 5

# Image layout.
HEADINGS = (0, 90, 180, 270)
IMAGE_VERSION = "v1"
LOCATION_PREFIX = "geo:v1:"
COLLECTION_BATCH = 25

# Snapshot columns that may be missing from old versions.
SNAPSHOT_SCHEMA = (
    "location_id string, lat double, lon double, heading int, capture_date string, "
    "pano_id string, batch_date string, image_path string"
)

MONTHS = {
    "01": "January",
    "02": "February",
    "03": "March",
    "04": "April",
    "05": "May",
    "06": "June",
    "07": "July",
    "08": "August",
    "09": "September",
    "10": "October",
    "11": "November",
    "12": "December",
}

# Country-name columns looked for in boundary files, in this order.
COUNTRY_COLUMNS = ("NAME_0", "COUNTRY", "NAME", "ADMIN", "SOVEREIGNT")

# Countries where people drive on the left.
LEFT_DRIVING = [
    "Australia",
    "Bangladesh",
    "Bermuda",
    "Bhutan",
    "Botswana",
    "Christmas Island",
    "Cocos Islands",
    "Eswatini",
    "Hong Kong",
    "India",
    "Indonesia",
    "Ireland",
    "Isle of Man",
    "Japan",
    "Jersey",
    "Kenya",
    "Lesotho",
    "Macau",
    "Malaysia",
    "Malta",
    "Namibia",
    "Nepal",
    "New Zealand",
    "Pitcairn Islands",
    "Singapore",
    "South Africa",
    "Sri Lanka",
    "Thailand",
    "Uganda",
    "United Kingdom",
    "United States Virgin Islands",
    "England",
    "Wales",
    "Scotland",
]

# Names written with a leading article in captions.
ARTICLE_COUNTRIES = [
    "Bahamas",
    "British Virgin Islands",
    "Cayman Islands",
    "Cocos Islands",
    "Comoros",
    "Cook Islands",
    "Falkland Islands",
    "Faroe Islands",
    "French Southern Territories",
    "Maldives",
    "Marshall Islands",
    "Netherlands",
    "Northern Mariana Islands",
    "Paracel Islands",
    "Philippines",
    "Pitcairn Islands",
    "Seychelles",
    "Solomon Islands",
    "Spratly Islands",
    "Turks and Caicos Islands",
    "United Arab Emirates",
    "United States",
]

# Legend of the climate raster.
CLIMATE_LEGEND = {
    1: "a tropical rainforest climate",
    2: "a tropical monsoon climate",
    3: "a tropical savanna climate",
    4: "an arid, hot desert climate",
    5: "an arid, cold desert climate",
    6: "a hot, semi-arid climate",
    7: "a cold, semi-arid climate",
    8: "a Mediterranean climate with a hot summer",
    9: "a Mediterranean climate with a warm summer",
    10: "a Mediterranean climate with a cold summer",
    11: "a humid subtropical monsoon climate",
    12: "a temperate oceanic monsoon climate",
    13: "a subpolar oceanic monsoon climate",
    14: "a humid subtropical climate",
    15: "a temperate oceanic climate",
    16: "a subpolar oceanic climate",
    17: "a Mediterranean humid continental climate with a hot summer",
    18: "a Mediterranean humid continental climate with a warm summer",
    19: "a Mediterranean subarctic climate with a cold summer",
    20: "a Mediterranean humid continental climate with a warm summer",
    21: "a humid continental monsoon climate with a hot summer",
    22: "a humid continental monsoon climate with a warm summer",
    23: "a subarctic monsoon climate",
    24: "an extremely cold subarctic monsoon climate",
    25: "a humid continental climate with a hot summer",
    26: "a humid continental climate with a warm summer",
    27: "a subarctic climate",
    28: "an extremely cold subarctic climate",
    29: "a polar tundra climate",
    30: "a polar ice cap climate",
}

# Repairs of unnamed first- and second-level regions.
REGION_REPAIRS = {
    1: {"United Kingdom": "England", "Ireland": "Cork", "Netherlands": "Zuid-Holland"},
    2: {"United Kingdom": "England"},
}
