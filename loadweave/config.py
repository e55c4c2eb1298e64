"""Constants of the forecasting problem, in one place."""

from __future__ import annotations

from dataclasses import dataclass

TARGET = "actual_load_mw"
LOCAL_ZONE = "America/Chicago"
SERIES_KEY = "series_id"


@dataclass(frozen=True)
class Layout:
    """How a table of regular time series is keyed, and the spacing of its rows."""

    keys: tuple[str, ...] = (SERIES_KEY,)
    ts: str = "timestamp"
    step: int = 3600  # seconds between consecutive rows

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError("a layout needs at least one key column; give a lone series a constant one")

    @property
    def order(self) -> list[str]:
        return [*self.keys, self.ts]


HOURLY = Layout()
DAILY = Layout(step=86400)

# --- Fixed values: model inputs, in the order the models expect them -------------------------
FEATURES = [
    "temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg",
    "hour", "dayofweek", "month", "is_weekend", "is_holiday",
    "load_lag_24", "load_lag_168",
]
FEATURES_V2 = FEATURES + [
    "hour_x_temp", "temp_c_roll_std_72",
    "is_extreme_heat_event", "is_extreme_cold_event", "is_holiday_x_extreme",
]
FEATURES_V3 = FEATURES_V2 + ["temp_change_vs_lag24", "is_high_precip_event"]

# --- Fixed values: columns of the core table and of a raw scoring slice ----------------------
CORE_COLUMNS = [
    "timestamp", "timestamp_central", "actual_load_mw",
    "temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg",
    "hour", "dayofweek", "month", "is_weekend", "is_holiday",
    "load_lag_24", "load_lag_168",
]
RAW_REQUIRED = [
    "temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg",
    "hour", "dayofweek", "month", "is_weekend", "is_holiday", "holiday_name",
    "load_lag_24", "load_lag_168", "hour_x_temp", "temp_c_roll_std_72",
    "temp_change_vs_lag24",
]
WEATHER_FIELDS = ["temp_c", "humidity_pct", "precip_mm"]
JOINED_VALUES = [TARGET, "temp_c", "humidity_pct", "precip_mm", "tmax", "tmin", "tavg"]

# --- Fixed values: stations and census anchors -----------------------------------------------
CITIES = ["san_antonio", "austin", "round_rock", "san_marcos"]
POPULATION = {
    2016: {"san_antonio": 1492510, "austin": 938200, "round_rock": 120955, "san_marcos": 61782},
    2018: {"san_antonio": 1532233, "austin": 962800, "round_rock": 129046, "san_marcos": 63802},
    2020: {"san_antonio": 1434625, "austin": 962163, "round_rock": 120556, "san_marcos": 68199},
    2022: {"san_antonio": 1472909, "austin": 978358, "round_rock": 127340, "san_marcos": 70572},
    2024: {"san_antonio": 1526656, "austin": 993588, "round_rock": 135665, "san_marcos": 74319},
}

# --- Fixed values: gate bounds, split, contract ----------------------------------------------
GATE_COLUMNS = ["timestamp", "actual_load_mw", "temp_c", "humidity_pct", "precip_mm"]
GATE_ROWS = 92688
GATE_ROW_TOLERANCE = 0.03
GATE_RANGES = {
    "actual_load_mw": (500.0, 30000.0),
    "temp_c": (-20.0, 50.0),
    "humidity_pct": (0.0, 100.0),
    "precip_mm": (0.0, None),
}
GATE_TIMESTAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\+00:00$"
TIMESTAMP_NAMES = ["interval_start_utc", "interval_start", "time", "timestamp"]

PURGE_DAYS = 7
TEST_START_LOCAL = "2025-08-13 00:00:00"
FIRST_TRAIN = "2016-01-08 00:00:00"
FIRST_VALIDATION = "2020-08-06 06:00:00"
N_FOLDS = 5

HEAT_Q, COLD_Q, PRECIP_Q = 0.95, 0.05, 0.95
PEAK_SHARE = 0.05
TREND_YEAR_SECONDS = 365 * 24 * 3600

# name -> (kind, lower bound, upper bound); None is open
FIELD_SPECS = {
    "temp_c": ("float", None, None),
    "humidity_pct": ("float", 0, 100),
    "precip_mm": ("float", 0, None),
    "tmax": ("float", None, None),
    "tmin": ("float", None, None),
    "tavg": ("float", None, None),
    "hour": ("int", 0, 23),
    "dayofweek": ("int", 0, 6),
    "month": ("int", 1, 12),
    "is_weekend": ("int", 0, 1),
    "is_holiday": ("int", 0, 1),
    "load_lag_24": ("float", 0, None),
    "load_lag_168": ("float", 0, None),
    "hour_x_temp": ("float", None, None),
    "temp_c_roll_std_72": ("float", 0, None),
    "is_extreme_heat_event": ("int", 0, 1),
    "is_extreme_cold_event": ("int", 0, 1),
    "is_holiday_x_extreme": ("int", 0, 1),
    "temp_change_vs_lag24": ("float", None, None),
    "is_high_precip_event": ("int", 0, 1),
    "holiday_freq": ("float", 0, 1),
    "trend_idx": ("float", None, None),
}
MODEL_NAME = "loadweave-load"
CHAMPION = "champion"
PARITY_TOLERANCE = 1e-4
SEED = 42
