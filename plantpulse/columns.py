"""Column names and fixed values of the sensor data model."""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMP = "timestamp"
RUN = "run_id"
STATUS = "health_status"
WARNING_TYPE = "warning_type"
FAILURE_TYPE = "failure_type"
FAULT_TYPE = "fault_type"

# --- Fixed values: these must equal the published data model for right results. ---

NORMAL = "Normal"
WARNING = "Warning"
FAILURE = "Failure"
STATUSES = (NORMAL, WARNING, FAILURE)

# Status labels that arrive cut short, and what they stand for.
STATUS_REPAIRS = {"Warnin": "Warning", "Failur": "Failure"}

STATUS_CODES = {"Normal": 0, "Warning": 1, "Failure": 2, "Error": 2}
UNKNOWN_STATUS_CODE = -1

# Sensor columns in file order, with the range sample readings are drawn from.
SENSOR_RANGES = {
    "accelerometer_g": (0.1, 0.5),
    "vibration_velocity_mm_s": (2.5, 4.0),
    "shaft_displacement_um": (30.0, 50.0),
    "bearing_temp_c": (60.0, 70.0),
    "oil_temp_c": (50.0, 60.0),
    "casing_temp_c": (55.0, 65.0),
    "inlet_fluid_temp_c": (40.0, 50.0),
    "outlet_fluid_temp_c": (50.0, 60.0),
    "inlet_pressure_bar": (2.0, 3.0),
    "outlet_pressure_bar": (6.0, 7.0),
    "flow_rate_m3_h": (85.0, 95.0),
    "motor_current_a": (35.0, 45.0),
    "supply_voltage_v": (395.0, 410.0),
    "power_consumption_kw": (18.0, 22.0),
    "sound_intensity_db": (70.0, 80.0),
}
SENSORS = tuple(SENSOR_RANGES)

# Warning and failure types in the order in which file names are tested for them.
WARNING_TYPES = (
    "radial_vibration_increase",
    "axial_vibration_increase",
    "bearing_temp_increase",
    "oil_temp_increase",
    "casing_temp_increase",
    "suction_pressure_drop",
    "discharge_pressure_drop",
    "flow_rate_decrease",
    "power_increase",
    "current_increase",
    "voltage_drop",
    "acoustic_noise_increase",
    "outlet_fluid_temp_increase",
    "flow_pressure_power_fluctuation",
    "bearing_vibration_temp_increase",
)
FAILURE_TYPES = (
    "bearing_fault",
    "shaft_misalignment",
    "rotor_imbalance",
    "cavitation",
    "pipe_blockage",
    "motor_overload",
    "voltage_drop",
    "seal_failure",
    "impeller_wear",
)
UNKNOWN_LABEL = "unknown"

# Raw file headers (Persian) and the column names they are translated to.
HEADER_TRANSLATION = {
    "زمان": "timestamp",
    "شتاب‌سنج (g)": "accelerometer_g",
    "سرعت لرزش (mm/s)": "vibration_velocity_mm_s",
    "جابجایی محور (µm)": "shaft_displacement_um",
    "دمای یاتاقان (°C)": "bearing_temp_c",
    "دمای روغن (°C)": "oil_temp_c",
    "دمای پوسته (°C)": "casing_temp_c",
    "دمای سیال ورودی (°C)": "inlet_fluid_temp_c",
    "دمای سیال خروجی (°C)": "outlet_fluid_temp_c",
    "فشار ورودی (bar)": "inlet_pressure_bar",
    "فشار خروجی (bar)": "outlet_pressure_bar",
    "دبی جریان (m³/h)": "flow_rate_m3_h",
    "جریان موتور (A)": "motor_current_a",
    "ولتاژ تغذیه (V)": "supply_voltage_v",
    "توان مصرفی (kW)": "power_consumption_kw",
    "شدت صوت (dB)": "sound_intensity_db",
    "وضعیت سلامت": "health_status",
}

# --- End of fixed values. ---

# CSV with a header, doubled quotes and microseconds, as most tools write it.
CSV_OPTIONS = {"header": True, "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}

READING_SCHEMA = T.StructType(
    [T.StructField(TIMESTAMP, T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in SENSORS]
    + [T.StructField(STATUS, T.StringType())]
)


def numeric_columns(schema: T.StructType, exclude=()) -> list[str]:
    """Names of the numeric columns of ``schema`` (booleans are not numeric), without ``exclude``."""
    skip = set(exclude)
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def require_columns(df, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
