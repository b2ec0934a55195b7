"""Fixed values.

Everything in this file is a constant that must match the plant's own
definitions for results to be right: station ids and locations, image profiles,
defect codes, header aliases, thresholds and legal ranges.
"""

# --- Fixed values: image profiles (profile, family letter, views, primary pair)
IMAGE_PROFILES = [
    ("5S", "D", ["A", "C", "E", "X", "Y"], ["A", "E"]),
    ("5X", "E", ["A", "B", "C", "E", "X", "Y"], ["A", "E"]),
    ("7S", "F", ["A", "C", "E", "X", "Y"], ["A", "E"]),
    ("7X", "G", ["A", "C", "E", "X", "Y"], ["A", "E"]),
]

# --- Fixed values: stations
# (id, group, name, location, station_type, image_profile, excel_profile)
STATIONS = [
    ("35_wp1", "3-5", "WP1", "3003.10.1.1.1", "wp", "5S", "wp"),
    ("35_wp2", "3-5", "WP2", "3003.10.1.1.2", "wp", "5S", "wp"),
    ("35_wp3", "3-5", "WP3", "3003.10.1.1.3", "wp", "5S", "wp"),
    ("35_wp4", "3-5", "WP4", "3003.10.1.1.4", "wp", "5S", "wp"),
    ("35_wp5", "3-5", "WP5", "3003.10.1.1.5", "wp", "5S", "wp"),
    ("35_5s_aoi", "3-5", "5s_AOI", "3003.10.1.1.6", "aoi", "5S", "aoi"),
    ("35_5s_vi", "3-5", "5s_VI", "3002.35.1.1.1", "vi", "5S", "vi"),
    ("57_wp1", "5-7", "WP1", "3004.20.1.1.1", "wp", "5X", "wp"),
    ("57_wp2", "5-7", "WP2", "3004.20.1.1.2", "wp", "5X", "wp"),
    ("57_wp3", "5-7", "WP3", "3004.20.1.1.3", "wp", "5X", "wp"),
    ("57_wp4", "5-7", "WP4", "3004.20.1.1.4", "wp", "5X", "wp"),
    ("57_wp5", "5-7", "WP5", "3004.20.1.1.5", "wp", "5X", "wp"),
    ("57_5x_aoi", "5-7", "5x_AOI", "3004.20.1.1.6", "aoi", "5X", "aoi"),
    ("57_5x_vi", "5-7", "5x_VI", "3002.35.1.1.2", "vi", "5X", "vi"),
    ("conveyor_7s_aoi", "Conveyor", "7s_AOI", "3002.30.1.1.1", "aoi", "7S", "aoi"),
    ("conveyor_7s_vi", "Conveyor", "7s_VI", "3002.35.1.1.3", "vi", "7S", "vi"),
    ("conveyor_7x_aoi", "Conveyor", "7x_AOI", "3002.30.1.1.2", "aoi", "7X", "aoi"),
    ("conveyor_7x_vi", "Conveyor", "7x_VI", "3002.35.1.1.4", "vi", "7X", "vi"),
]

# --- Fixed values: which VI station follows which AOI station
FOLLOW_UP_STATION = {
    "35_5s_aoi": "35_5s_vi",
    "57_5x_aoi": "57_5x_vi",
    "conveyor_7s_aoi": "conveyor_7s_vi",
    "conveyor_7x_aoi": "conveyor_7x_vi",
}

# --- Fixed values: station-id token -> analysis scope, first match wins
SCOPE_TOKENS = [("_5s_", "5S"), ("_5x_", "5X"), ("_7s_", "7S"), ("_7x_", "7X")]

# --- Fixed values: built-in defect catalog
# (layer, code, name, region, description, enabled, version)
DEFECT_CODES = [
    ("5", "5010", "CCM活性区波浪", "活性区", "", "true", "2026.1"),
    ("5", "5011", "折皱-活性区", "活性区", "", "true", "2026.1"),
    ("5", "6011", "折皱-交界区", "交界区", "", "true", "2026.1"),
    ("5", "5013", "交界区波浪", "交界区", "", "true", "2026.1"),
    ("5", "5012", "交界区翻折", "交界区", "", "true", "2026.1"),
    ("5", "5032", "CCM吸风辊凹坑", "CCM", "", "true", "2026.1"),
    ("5", "5020", "颗粒/纤维/残留", "活性区", "", "true", "2026.1"),
    ("5", "5020", "颗粒/纤维/残留", "交界区", "", "true", "2026.1"),
    ("5", "5021", "切割残留", "CCM", "", "true", "2026.1"),
    ("5", "5030", "CCM擦痕", "CCM", "", "true", "2026.1"),
    ("5", "5075", "CCM催化层网状裂纹", "CCM", "", "true", "2026.1"),
    ("5", "5031", "CCM涂层缺失", "CCM", "", "true", "2026.1"),
    ("5", "5050", "背光图白点", "CCM/交界区", "", "true", "2026.1"),
    ("5", "5040", "CCM焊接宽度异常", "CCM", "", "true", "2026.1"),
    ("5", "5070", "CCM原料标记", "CCM", "", "true", "2026.1"),
    ("5", "5099", "CCM未预贴好", "CCM", "", "true", "2026.1"),
    ("5", "5061", "CCM假料", "CCM", "", "true", "2026.1"),
    ("5", "5060", "接头", "SG/CCM", "", "true", "2026.1"),
    ("5", "5510", "SG窗口毛边", "SG", "", "true", "2026.1"),
    ("5", "5520", "交界贴合不均匀", "交界区", "", "true", "2026.1"),
    ("7", "7010", "SG折皱", "SG", "", "true", "2026.1"),
    ("7", "7020", "SG气泡", "SG", "", "true", "2026.1"),
    ("7", "7030", "SG污染", "SG", "", "true", "2026.1"),
    ("7", "7040", "SG表面损伤", "SG", "", "true", "2026.1"),
    ("7", "7050", "SG边缘切割不均匀", "SG", "", "true", "2026.1"),
    ("7", "7510", "GDL裂缝", "GDL", "", "true", "2026.1"),
    ("7", "7520", "GDL脱落", "GDL", "", "true", "2026.1"),
    ("7", "7521", "GDL缺失", "GDL", "", "true", "2026.1"),
    ("7", "7540", "胶水溢出", "GDL", "", "true", "2026.1"),
    ("7", "7550", "MEA表面异物", "MEA", "", "true", "2026.1"),
    ("7", "7560", "GDL边缘切割不均匀", "GDL", "", "true", "2026.1"),
    ("7", "7575", "GDL原料发现", "GDL", "", "true", "2026.1"),
    ("7", "7098", "SG接头", "SG", "", "true", "2026.1"),
    ("7", "7599", "多层GDL", "GDL", "", "true", "2026.1"),
]

# --- Fixed values: catalog spellings that mean "disabled"
DISABLED_WORDS = ["0", "false", "no", "off", "否"]

# --- Fixed values: accepted image suffixes
IMAGE_SUFFIXES = ["bmp", "jpeg", "jpg", "png", "tif", "tiff"]

# --- Fixed values: file-name pattern <product><yyyymmdd><family><view>
IMAGE_STEM_PATTERN = r"(?i)^(.+)(\d{8})([DEFG])([A-Z])$"

# --- Fixed values: header aliases of station worksheets (normalised text, in order)
STATION_HEADER_ALIASES = {
    "dmc_raw": ["identno", "uniquepartidentno"],
    "test_date": ["testdate", "packagingdate"],
    "state_raw": ["state", "statetest"],
    "line": ["line"],
    "st": ["st"],
    "si": ["si"],
    "fu": ["fu"],
    "wp": ["wp"],
    "tp": ["tp"],
    "ttnr": ["ttnr"],
    "variant": ["variant"],
    "batch": ["batch"],
}

# --- Fixed values: header aliases of measurement sheets (normalised text, in order)
MEASUREMENT_HEADER_ALIASES = {
    "dmc_raw": ["identno", "dmc", "dmcraw"],
    "ttnr": ["ttnr"],
    "variant": ["variant"],
    "batch": ["batch", "batchid"],
    "state": ["state", "statetest", "resultstate", "resultaoiresult", "aoiresult"],
    "line": ["line", "location", "locations"],
    "test_date": ["testdate"],
    "result_timestamp": ["resulttimestamping", "timestamp", "productiontimestamp"],
}

# --- Fixed values: header tokens kept on station events for truth review
RESULT_LABEL_TOKENS = [
    "failurecode", "failurescode", "blockcode", "resultfrom",
    "overallresultstate", "forwardresult", "backwardresult",
]

# --- Fixed values: header tokens that hold failure codes
FAILURE_CODE_TOKENS = ["failurecode", "failurescode", "blockcode"]

# --- Fixed values: the two header spellings of the AOI failure code, the VI sheet
AOI_CODE_HEADERS = ["aoifailurecode", "resultaoifailurecode"]
VI_CODE_HEADER = "blockcode"
VI_SHEET_KEY = "ms0335all"

# --- Fixed values: categorical fields counted per measurement profile
CATEGORICAL_FIELDS = {
    "aoi": ["aoifailurecode"],
    "vi": [
        "blockcode", "documentversion", "fail1", "failuresarea", "failurescode",
        "resultaoiresult", "resultfrom", "stationno",
    ],
    "wp": [],
}

# --- Fixed values: headers that reveal the measurement profile
VI_PROFILE_HEADERS = ["failuresarea", "failurescode", "stationno", "documentversion"]
AOI_PROFILE_HEADER = "aoifailurecode"

# --- Fixed values: recorded verdict spellings
OK_WORDS = ["OK", "GOOD", "PASS", "PASSED"]
NOK_WORDS = ["NOK", "NG", "FAIL", "FAILED"]

# --- Fixed values: a tolerance is two numbers around .. … ~ ～ to, or around a dash with blanks
TOLERANCE_PATTERN = (
    r"(?i)^\s*([-+]?\d+(?:\.\d+)?)(?:\s*(?:\.{2,}|…|~|～|to)\s*|\s+-\s+)([-+]?\d+(?:\.\d+)?)\s*$"
)

# --- Fixed values: join keys of process data, in preference order
EXACT_KEYS = ["product_id", "order_code", "dmc_raw", "global_order"]
TIME_KEYS = ["production_timestamp", "timestamp"]

# --- Fixed values: numeric columns that are never process parameters
NON_PARAMETERS = [
    "global_order", "has_defect", "defect_count", "detected_defect_count",
    "has_detected_defect", "image_width", "image_height",
]

# --- Fixed values: code statuses that count as a defect
DEFECT_STATUSES = ["defect", "state_code_conflict"]

# --- Fixed values: legal ranges of settings
INTEGER_RANGES = {
    "red_min": (0, 255),
    "red_dominance": (0, 255),
    "morph_kernel_size": (1, 31),
    "min_component_area": (1, 10_000_000),
    "max_component_area": (1, 100_000_000),
    "micro_max_component_area": (1, 10_000_000),
    "minimum_repeat_occurrences": (2, 10_000),
    "minimum_period": (1, 1_000_000),
    "maximum_period": (1, 1_000_000),
    "period_order_tolerance": (0, 1000),
    "burst_minimum_length": (2, 100_000),
    "missing_order_tolerance": (0, 1000),
    "warning_lead_products": (0, 1_000_000),
    "trajectory_min_occurrences": (2, 10_000),
    "preview_count": (0, 1000),
}
FLOAT_RANGES = {
    "region_min_width_ratio": (0.01, 1.0),
    "region_min_height_ratio": (0.01, 1.0),
    "spatial_cluster_radius_norm": (0.000001, 1.0),
    "minimum_period_precision": (0.0, 1.0),
    "minimum_period_coverage": (0.0, 1.0),
    "registration_min_score": (0.0, 1.0),
    "horizontal_y_tolerance_norm": (0.0001, 1.0),
    "horizontal_min_x_span_norm": (0.0001, 1.0),
    "linear_drift_min_abs_spearman": (0.0, 1.0),
    "evaluation_center_tolerance_px": (0.0, 10000.0),
}
