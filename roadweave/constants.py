"""Fixed values of the two highway feeds."""

from __future__ import annotations

# --- fixed values: detector (VD) feed -------------------------------------
ROUTE_KEYWORDS = ("圓山", "台北", "三重", "N1-N-2", "N1-S-2")
ROUTE_KM_LOW, ROUTE_KM_HIGH = 20, 30
VD_FILE_KEYWORDS = ("vd", "traffic", "detector", "靜態", "動態")

WEEKDAY_PEAK, WEEKDAY_OFFPEAK = "平日尖峰", "平日離峰"
WEEKEND_PEAK, WEEKEND_OFFPEAK = "假日尖峰", "假日離峰"

# --- fixed values: cleaning limits (inclusive) ----------------------------
VALID_RANGES = {
    "speed": (0, 150),
    "occupancy": (0, 100),
    "volume_total": (0, 100),
    "volume_small": (0, 100),
    "volume_large": (0, 50),
    "volume_truck": (0, 50),
    "speed_small": (0, 150),
    "speed_large": (0, 150),
    "speed_truck": (0, 150),
}
INVALID_MARKERS = (-99.0, -1.0, 999.0, 9999.0, float("inf"), float("-inf"))

# --- fixed values: gantry (eTag) feed -------------------------------------
# pair id, segment name, distance in km, direction
GANTRY_PAIRS = (
    ("01F0017N-01F0005N", "台北→圓山", 1.8, "N"),
    ("01F0005S-01F0017S", "圓山→台北", 1.8, "S"),
    ("01F0029N-01F0017N", "三重→台北", 2.0, "N"),
    ("01F0017S-01F0029S", "台北→三重", 2.0, "S"),
)
VEHICLE_NAMES = {
    "31": "小客車",
    "32": "小貨車",
    "41": "大客車",
    "42": "大貨車",
    "5": "聯結車",
}
DEFAULT_VEHICLE = "31"

# --- fixed values: region -> gantry pairs ---------------------------------
REGION_PAIRS = {
    "圓山": ("01F0017N-01F0005N", "01F0005S-01F0017S"),
    "台北": (
        "01F0017N-01F0005N",
        "01F0005S-01F0017S",
        "01F0029N-01F0017N",
        "01F0017S-01F0029S",
    ),
    "三重": ("01F0029N-01F0017N", "01F0017S-01F0029S"),
}
REGION_CODES = {"圓山": 1, "台北": 2, "三重": 3}

BIN_MINUTES = 5
SYNC_TOLERANCE_MIN = 2.0

# --- fixed values: forecast confidences (labelled constants, not measured) -
FUSED_CONFIDENCE = {"gbt": 88, "random_forest": 82, "ensemble": 92}
STATION_CONFIDENCE = {"gbt": 85, "random_forest": 80, "sequence": 90}
SERVING_WEIGHTS = {"gbt": 0.7, "random_forest": 0.3}
WEIGHT_GRID = ((0.7, 0.3), (0.8, 0.2), (0.6, 0.4), (0.5, 0.5), (0.9, 0.1))
