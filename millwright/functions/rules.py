"""Domain classifiers as CASE chains generated from rule tables (first match wins)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal-name pattern -> canonical role, in order of precedence.
SIGNAL_ROLES = [
    (r"ALM_ARR_MSG|ALERT", "alarm"),
    (r"SERVO_MOTOR_TEMPERATURE|TEMPERATURE", "servo_temp"),
    (r"POWER_CONSUMPTION.*SPINDLE", "spindle_power"),
    (r"POWER_CONSUMPTION", "servo_power"),
    (r"PATH_LOAD", "path_load"),
    (r"CYCLE_TIME", "cycle_time"),
    (r"IsNotRunning|RUN_STATUS_START|STATINFO_RUN", "run_state"),
    (r"RUN_STATUS_(PAUSE|RESET|STOP)|NC_MODE|EXECUTION|HEAD__", "machine_mode"),
    (r"RUN_TIME|START_TIME", "run_time"),
    (r"System Offline|Undefined Stoppage|M30|MagazineToolChange|Duruş|Bekliyor|SpeedLevel", "stop_event"),
    (r"PROGRAM_POSITION|TCP_.*POSITION|NEXT_DISTANCE|COMMAND_2", "axis_position"),
    (r"RUNNING_PROGRAM_NO|PROGRAM_NUMBER|ProgramNo|StockCode", "program"),
    (r"PIECES_PRODUCED", "production_count"),
    (r"^Counter$|Mill_._Work", "counter"),
    (r"Manual Stock|^Stock", "stock"),
    (r"Manual Scrap|Scrap", "scrap"),
    (r"Manual Workorder|WORK_ORDER", "workorder"),
    (r"Test Production|TEST_PROD", "test_prod"),
]

# Roles that carry mechanical evidence, and roles that feed the feature grid.
EVIDENCE_ROLES = ["servo_temp", "spindle_power", "servo_power", "path_load", "cycle_time"]
FEATURE_ROLES = ["cycle_time", "axis_position", "run_time", "run_state", "production_count", "machine_mode"]
OVERLAY_ROLES = ["run_state", "cycle_time", "axis_position", "run_time", "production_count"]

# Collector type -> vendor.
VENDORS = {"FanucFocas": "Fanuc", "MitsubishiCnc": "Mitsubishi", "LibPlc": "Nukon"}

# Upper-cased alarm text pattern -> alarm category.
ALARM_CATEGORIES = [
    (r"AIR\s*PRESSURE", "AIR_PRESSURE"),
    (r"LUBE|LUBRICAT", "LUBE_OIL"),
    (r"CHUCK", "CHUCK"),
    (r"Z\s*AXIS.*ZERO|ZERO\s*RETURN|REFERENCE\s*POS", "AXIS_ZERO_RETURN"),
    (r"OVERTRAVEL|OVER\s*TRAVEL", "OVERTRAVEL"),
    (r"DOOR|INTERLOCK", "DOOR_INTERLOCK"),
    (r"MOTOR\s*OVERLOAD|OVERLOAD", "MOTOR_OVERLOAD"),
    (r"EMERGENCY\s*STOP|ACIL", "EMERGENCY_STOP"),
    (r"ILLEGAL|FORMAT|COMMAND", "PROGRAM_ERROR"),
]

# Words of a stop reason, lower case, by category.
OFFLINE_WORDS = ["system offline", "offline"]
WAITING_WORDS = ["bekliyor", "waiting"]
PLANNED_WORDS = ["mola", "ayar", "sevkiyat", "magazin", "takım", "tool", "m30"]
UNPLANNED_WORDS = ["duruş", "durus", "isnotrunning", "not running", "undefined"]

# Causal rank of an alarm category, most upstream first.
CAUSAL_RANK = {
    "AIR_PRESSURE": 0, "LUBE_OIL": 1, "MOTOR_OVERLOAD": 2, "CHUCK": 3, "AXIS_ZERO_RETURN": 4,
    "OVERTRAVEL": 5, "PROGRAM_ERROR": 6, "DOOR_INTERLOCK": 7, "EMERGENCY_STOP": 8, "OTHER_ALARM": 9,
}

# Share of a category's downtime a fix is assumed to recover.
RECOVERY_SHARE = {
    "UNPLANNED_RUNSTOP": 0.5, "AIR_PRESSURE": 0.8, "LUBE_OIL": 0.7, "CHUCK": 0.6, "DOOR_INTERLOCK": 0.5,
    "AXIS_ZERO_RETURN": 0.6, "EMERGENCY_STOP": 0.3, "WAITING_WORK": 0.4, "CONNECTIVITY": 0.0,
    "ANOMALY": 0.5, "OTHER": 0.3, "OTHER_ALARM": 0.3,
}

# Facility-level cause of a category seen on several machines at once.
FACILITY_CAUSE = {
    "CONNECTIVITY": "FACILITY_NETWORK", "AIR_PRESSURE": "FACILITY_AIR",
    "EMERGENCY_STOP": "FACILITY_POWER_OR_SAFETY",
}

# Hypothesis templates per category: cause, likelihood, rationale, action.
HYPOTHESES = {
    "AIR_PRESSURE": [
        ("Pneumatic supply pressure loss (facility/compressor)", 0.7,
         "Air-pressure alarm fired; downstream axis/chuck faults are typical consequences",
         "Check compressor, air lines, pressure switch; add pressure monitoring"),
        ("Faulty pressure switch / sensor", 0.2,
         "Recurring air-pressure alarms without process change", "Replace/recalibrate switch"),
    ],
    "AXIS_ZERO_RETURN": [
        ("Reference lost after upstream fault (e.g. air pressure / e-stop)", 0.6,
         "Zero-return alarm commonly follows a power/pneumatic interruption",
         "Re-home axis; address the upstream trigger"),
        ("Encoder / homing switch fault", 0.3, "Repeated zero-return without upstream cause",
         "Inspect encoder and homing hardware"),
    ],
    "DOOR_INTERLOCK": [
        ("Safety door opened during cycle", 0.6, "Interlock alarm during production",
         "Operator training; verify guarding procedure"),
        ("Faulty door switch", 0.3, "Recurring interlock alarms", "Replace door switch"),
    ],
    "EMERGENCY_STOP": [
        ("Operator/safety-circuit intervention", 0.6, "E-stop is typically a reaction",
         "Review the triggering condition that prompted the stop"),
    ],
    "CONNECTIVITY": [
        ("Collector / network outage (not a machine fault)", 0.9,
         "System Offline = collector lost connection; no machine telemetry during window",
         "Fix network/collector reliability — does NOT recover machine OEE"),
    ],
    "UNPLANNED_RUNSTOP": [
        ("Unclassified machine stop (missing operator reason)", 0.5,
         "IsNotRunning/Duruş with no alarm or offline overlap",
         "Improve stop-reason classification; investigate top recurring windows"),
    ],
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str, ignore_case: bool = True) -> Column:
    out = None
    for pattern, label in rules:
        cond = text.rlike(("(?iu)" if ignore_case else "") + pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def any_word(text: Column, words: Iterable[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def choose(key: Column, table: dict, default=None) -> Column:
    """Dictionary lookup as a constant-folded CASE; a missing key gives the default."""
    out = None
    for k, v in table.items():
        cond = key == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def signal_role(name: Column | str) -> Column:
    return first_match(_c(name), SIGNAL_ROLES, "other")


def vendor(collector: Column | str) -> Column:
    return choose(_c(collector), VENDORS)


def alarm_category(text: Column | str) -> Column:
    return first_match(F.upper(_c(text)), ALARM_CATEGORIES, "OTHER_ALARM", ignore_case=False)


def stop_category(text: Column | str, planned: Column | str) -> Column:
    t, p = F.lower(F.coalesce(_c(text), F.lit(""))), _c(planned)
    return (
        F.when(any_word(t, OFFLINE_WORDS), "CONNECTIVITY")
        .when(any_word(t, WAITING_WORDS), "WAITING_WORK")
        .when(any_word(t, PLANNED_WORDS), "PLANNED_BREAK")
        .when(p, "PLANNED_BREAK")
        .when(any_word(t, UNPLANNED_WORDS), "UNPLANNED_RUNSTOP")
        .when(~p, "UNPLANNED_RUNSTOP")
        .otherwise("OTHER")
    )


def is_offline_reason(text: Column | str) -> Column:
    return F.lower(F.coalesce(_c(text), F.lit(""))).contains("system offline")


def causal_rank(category: Column | str) -> Column:
    return choose(_c(category), CAUSAL_RANK, 99)


def recovery_share(category: Column | str) -> Column:
    return choose(_c(category), RECOVERY_SHARE, 0.5)


def facility_cause(category: Column | str) -> Column:
    return choose(_c(category), FACILITY_CAUSE, "MULTI_MACHINE")


def causal_pattern(has_alarm: Column, lag_s: Column, has_drift: Column, is_connectivity: Column) -> Column:
    """Causal shape of an incident; a lag of exactly one minute still counts as caused by the alarm."""
    return (
        F.when(is_connectivity, "CONNECTIVITY")
        .when(has_alarm & has_drift, "DRIFT_ALARM_STOP")
        .when(has_alarm & (lag_s <= 60), "ALARM_CAUSED_STOP")
        .when(has_alarm, "ALARM_RELATED_STOP")
        .otherwise("OPERATIONAL_STOP")
    )


def reason_kind(reason: Column | str) -> Column:
    return F.when(_c(reason).rlike("(?iu)Offline|Connect"), "connectivity").otherwise("fault")


def tier(has_telemetry: Column, vendor_name: Column, rich_vendors: Iterable[str] = ("Mitsubishi",)) -> Column:
    return (
        F.when(~F.coalesce(has_telemetry, F.lit(False)), "Blind (MES-only)")
        .when(vendor_name.isin(*rich_vendors), "Rich (temp/load*)")
        .otherwise("Sparse (cycle/run)")
    )


def regime(machine: Column, groups: dict[str, Iterable[str]], default: str) -> Column:
    """Label of the first group listing the machine."""
    out = None
    for label, members in groups.items():
        cond = machine.isin(*members)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return (out.otherwise(default)) if out is not None else F.lit(default)
