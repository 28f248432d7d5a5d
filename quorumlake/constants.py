"""Fixed values of the certification protocol and of the five-table extract."""

from __future__ import annotations

# The certification protocol. Results depend on every one of them.
SEED = 20260721
SPLIT_FRACTIONS = (0.40, 0.20, 0.40)
ALPHA_LADDER = (0.05, 0.10)
DELTA = 0.05
BBSE_DELTA_CONF = 0.025
BBSE_DELTA_BET = 0.025
BBSE_BONFERRONI = 4
M_INFLUENCE = 100
WSR_LAMBDA_CAP = 0.9
WSR_VAR_FLOOR = 1e-8
WSR_MU0, WSR_S2_0 = 0.5, 0.25
MIN_CAL_CLUSTERS = 50
MIN_ANSWERABLE = 10
BBSE_GAP_FLOOR = 0.10
BBSE_MIN_TARGET_SITES = 10
BBSE_BOOT = 2000
BBSE_BOOT_MAX_ATTEMPTS = 4000
ESTIMATE_BOOT = 500
ESTIMATE_BOOT_MAX_ATTEMPTS = 1000
PI_CLIP = 1e-4
SD_REL_TOL = 1e-9
HEAD_C = 1.0
HEAD_MAX_ITER = 2000
MODE_BASELINE, MODE_BBSE = 0, 1
LOGIT_HEADROOM = 1e-9
WILSON_Z95 = 1.6448536269514722


def tau_grid() -> list[float]:
    """The 23 thresholds from 0.55 to 0.99, as evenly spaced doubles; not what their two decimals parse to."""
    import numpy as np

    return np.linspace(0.55, 0.99, 23).tolist()


TAU_GRID = tau_grid()

# The five-table extract and its gates.
TABLES = ("patient", "hospital", "apacheApsVar", "apachePredVar", "apachePatientResult")
SITE_PREFIX = "hosp-"
LABEL_COLUMN, POSITIVE_LABEL, NEGATIVE_LABEL = "hospitaldischargestatus", "Expired", "Alive"
MIN_AGE, AGE_MASK_TOKEN, AGE_MASK_VALUE = 18, "> 89", 90.0
SENTINEL_MISSING = -1.0
IMPUTE_FALLBACK = 0.0
VERSION_PREFERENCE = ("IVa", "IV")
MAX_OTHER_SHARE = 0.05
MAX_CROSS_SITE_SHARE = 0.01
N_TARGET_SITES = 24
SPLIT_NAMESPACE = 9
MIN_TOTAL_SITES = 149
N_FEATURES = 161
ARMS = ("primary", "apache-linked", "apache-complete")
MAX_OUTCOME_PREVALENCE_RATIO = 2.0
MIN_OUTCOME_STRATUM = 100
FEATURE_AUC_REVIEW = 0.75
MAX_UNPARSEABLE_SHARE = 0.01
MAX_NEGATIVE_SHARE = 0.01
MAX_KEY_UNPARSEABLE_SHARE = 0.01
LEAK_AUC_CAP, LEAK_DROP_CAP = 0.90, 0.05
MIN_OPERATIVE_COVERAGE = 0.20
SUCCESS_COVERAGE_ALARM, SUCCESS_RISK_ALARM = 0.90, 0.01
MIN_REPORTED_SITES = 200
ATTRITION_STEPS = (
    "raw-unit-stays", "site-parseable", "outcome-known", "adult", "first-stay", "primary-cohort",
    "apache-aps-linked", "apache-result-linked", "apache-complete-arm",
)
REFERENCE_ROW_COUNTS = {"patient": 200859, "hospital": 208, "apacheApsVar": 171177, "apachePredVar": 171177, "apachePatientResult": 297064}
REFERENCE_SITES, REFERENCE_PATIENTS, REFERENCE_UNIT_STAYS = 208, 139367, 200859

# Feature blocks and frozen levels.
PATIENT_NUMERIC = ("age", "admissionheight", "admissionweight", "pre_icu_hours")
LEVELS_GENDER = ("Female", "Male", "Other", "Unknown", "", "OTHER")
LEVELS_ETHNICITY = ("African American", "Asian", "Caucasian", "Hispanic", "Native American", "Other/Unknown", "", "OTHER")
LEVELS_ADMITSOURCE = (
    "Acute Care/Floor", "Chest Pain Center", "Direct Admit", "Emergency Department", "Floor", "ICU", "ICU to SDU", "Observation", "Operating Room",
    "Other", "Other Hospital", "Other ICU", "PACU", "Recovery Room", "Step-Down Unit (SDU)", "", "OTHER",
)
LEVELS_UNITTYPE = ("CCU-CTICU", "CSICU", "CTICU", "Cardiac ICU", "MICU", "Med-Surg ICU", "Neuro ICU", "SICU", "", "OTHER")
LEVELS_UNITSTAYTYPE = ("admit", "readmit", "stepdown/other", "transfer", "", "OTHER")
CATEGORICALS = (
    ("gender", LEVELS_GENDER), ("ethnicity", LEVELS_ETHNICITY), ("hospitaladmitsource", LEVELS_ADMITSOURCE),
    ("unitadmitsource", LEVELS_ADMITSOURCE), ("unittype", LEVELS_UNITTYPE), ("unitstaytype", LEVELS_UNITSTAYTYPE),
)
APS_NUMERIC = (
    "intubated", "vent", "dialysis", "eyes", "motor", "verbal", "meds", "urine", "wbc", "temperature", "respiratoryrate", "sodium",
    "heartrate", "meanbp", "ph", "hematocrit", "creatinine", "albumin", "pao2", "pco2", "bun", "glucose", "bilirubin", "fio2",
)
APV_NUMERIC = (
    "graftcount", "thrombolytics", "aids", "hepaticfailure", "lymphoma", "metastaticcancer", "leukemia", "immunosuppression", "cirrhosis",
    "electivesurgery", "activetx", "readmit", "ima", "midur", "ventday1", "oobventday1", "oobintubday1", "diabetes", "ejectfx",
)

# Plausibility windows.
WINDOW_HEIGHT_CM = (100.0, 250.0)
WINDOW_WEIGHT_KG = (20.0, 300.0)
WINDOW_PRE_ICU_HOURS = (0.0, 720.0)
WINDOW_FIO2_FRACTION = (0.21, 1.0)
WINDOW_FIO2_PERCENT = (21.0, 100.0)
WINDOW_TEMP_C = (25.0, 45.0)
WINDOW_TEMP_F = (77.0, 113.0)

# Columns that may never become features.
LEAK_COLUMNS = (
    "diedinhospital", "actualhospitalmortality", "actualicumortality", "hospitaldischargestatus", "unitdischargestatus",
    "hospitaldischargelocation", "unitdischargelocation", "hospitaldischargeoffset", "unitdischargeoffset", "hospitaldischargetime24",
    "unitdischargetime24", "dischargeweight", "actualiculos", "actualhospitallos", "unabridgedunitlos", "unabridgedhosplos", "actualventdays",
    "unabridgedactualventdays", "saps3today", "saps3yesterday", "var03hspxlos", "dischargelocation", "hospitalid", "wardid",
    "hospitaldischargeyear", "predictedhospitalmortality", "predictedicumortality", "predictediculos", "predictedhospitallos", "predventdays",
    "apachescore", "acutephysiologyscore", "physicianspeciality", "physicianinterventioncategory", "apacheadmissiondx", "unitvisitnumber",
)

# Columns each table of the extract must have.
REQUIRED_COLUMNS = {
    "patient": (
        "patientunitstayid", "patienthealthsystemstayid", "gender", "age", "ethnicity", "hospitalid", "admissionheight", "hospitaladmitoffset",
        "hospitaladmitsource", "hospitaldischargestatus", "hospitaldischargeyear", "unittype", "unitadmitsource", "unitvisitnumber",
        "unitstaytype", "admissionweight", "unitdischargestatus", "uniquepid",
    ),
    "hospital": ("hospitalid", "numbedscategory", "teachingstatus", "region"),
    "apacheApsVar": ("apacheapsvarid", "patientunitstayid", *APS_NUMERIC),
    "apachePredVar": ("apachepredvarid", "patientunitstayid", *APV_NUMERIC),
    "apachePatientResult": ("apachepatientresultsid", "patientunitstayid", "apacheversion", "predictedhospitalmortality"),
}

# Keys that no aggregate output may hold, and the longest sequence it may hold.
MAX_SEQUENCE = 512
