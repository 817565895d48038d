"""Code sets of the clinical source systems.

Fixed values: item codes, recorded texts and their grouping are properties of the source data, and
results depend on every one of them.
"""

VENT_TYPE = {720: "Other/Remarks", 223848: "Other"}  # any recorded value but this one
VENT_MODE = (223849,)
O2_DEVICE = 467
VENT_DEVICE_VALUE = "Ventilator"

MINUTE_VOLUME = (445, 448, 449, 450, 1340, 1486, 1600, 224687)
TIDAL_VOLUME = (639, 654, 681, 682, 683, 684, 224684, 224685, 224686)
RESP_PRESSURE = (218, 436, 444, 535, 224695, 224696, 224697, 224746, 224747)
INSP_PRESSURE = (1, 221, 1211, 1655, 2000, 224419, 224738, 224750, 226873, 227187)
PLATEAU_PRESSURE = (543,)
APRV_PRESSURE = (5865, 5866, 224705, 224706, 224707, 224709)
PEEP_SETTING = (60, 437, 505, 506, 686, 220339, 224700)
HIGH_PRESSURE_RELIEF = (3459,)
PCV = (501, 502, 503, 224702)
TCPCV = (223, 667, 668, 669, 670, 671, 672)
PSV_LEVEL = (224701,)

VENT_SETTINGS = (
    MINUTE_VOLUME
    + TIDAL_VOLUME
    + RESP_PRESSURE
    + INSP_PRESSURE
    + PLATEAU_PRESSURE
    + APRV_PRESSURE
    + PEEP_SETTING
    + HIGH_PRESSURE_RELIEF
    + PCV
    + TCPCV
    + PSV_LEVEL
)

EXTUBATION_NOTE = 640
EXTUBATED_VALUE = "Extubated"
SELF_EXTUBATED_VALUE = "Self Extubation"

O2_DELIVERY = (468, 469, 470, 471, 223834, 226732, 227287)
OXYGEN_VALUES = {
    226732: (
        "Aerosol-cool",
        "Face tent",
        "High flow nasal cannula",
        "High flow neb",
        "Medium conc mask ",
        "Nasal cannula",
        "Non-rebreather",
        "T-piece",
        "Trach mask ",
        "Ultrasonic neb",
        "Vapomist",
        "Venti mask ",
    ),
    467: (
        "Aerosol-Cool",
        "Cannula",
        "Face Tent",
        "Heated Neb",
        "Hi Flow Neb",
        "Hood",
        "Hut",
        "Medium Conc Mask",
        "Nasal Cannula",
        "Non-Rebreather",
        "T-Piece",
        "Trach Mask",
        "TranstrachealCat",
        "Ultrasonic Neb",
        "Vapotherm",
        "Venti Mask",
    ),
}

PROCEDURE_EXTUBATIONS = (225468, 225477, 227194)
PROCEDURE_SELF_EXTUBATION = 225468

SPO2 = (646, 220277)
PAO2 = (490, 50821)

CHART_CATEGORIES = {
    "Spo2": SPO2,
    "Fio2": (190, 3420, 3422, 223835),
    "Peep": (505, 506, 220339),
    "Vt": (682, 224685),
    "Map": (52, 6702, 220052, 225312),
    "Temperature": (676, 677, 223762),
    "Mv": MINUTE_VOLUME,
}
LAB_CATEGORIES = {
    "Pao2": PAO2,
    "Paco2": (50818,),
    "Sao2": (50817,),
    "Ph": (50820, 50831),
    "Hemoglobin": (50811,),
    "Co2": (50804,),
}

CHARTED_VASOPRESSORS = (
    30042, 30043, 30044, 30047, 30051, 30119, 30120, 30125, 30127, 30128,
    30306, 30307, 30309, 42273, 42802,
)
SWAPPED_RATE_AMOUNT = (42273, 42802)
STOP_WORDS = ("D/C'd", "Stopped")
ORDERED_VASOPRESSORS = (221289, 221653, 221662, 221749, 221906, 221986, 222315)
VOID_ORDER_STATUS = "Rewritten"

CHART_MAX_GAP = 120
INDEX_MAX_GAP = 30
HEMOGLOBIN_MAX_GAP = 1440
EPISODE_GAP = "8 hours"
EPISODE_CAP = "1 day"
