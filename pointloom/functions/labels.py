"""Class codes, their names and the translation of older codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of the classes that stages assign.
UNKNOWN, ROAD, GROUND, BUILDING, TREE, CAR = 0, 1, 9, 10, 30, 40
STREET_LIGHT, TRAFFIC_LIGHT, TRAFFIC_SIGN, TRAM_CABLE, CABLE = 60, 61, 62, 70, 79
CITY_BENCH, RUBBISH_BIN, HANGING_LIGHT, NOISE = 80, 81, 90, 99

# Names of all class codes.
NAMES = {
    0: "Unknown", 1: "Road", 2: "Sidewalk", 9: "Other ground", 10: "Building", 11: "Wall", 12: "Fence", 13: "Houseboat",
    14: "Bridge", 15: "Bus/tram shelter", 16: "Advertising column", 17: "Kiosk", 29: "Other structure", 30: "Tree",
    31: "Potted plant", 39: "Other vegetation ", 40: "Car", 41: "Truck", 42: "Bus", 43: "Tram", 44: "Bicycle",
    45: "Scooter/Motorcycle", 49: "Other vehicle", 50: "Person", 51: "Person sitting", 52: "Cyclist", 59: "Other Person",
    60: "Streetlight", 61: "Traffic light", 62: "Traffic sign", 63: "Signpost", 64: "Flagpole", 65: "Bollard", 66: "Parasol",
    68: "Complex pole", 69: "Other pole", 70: "Tram cable", 79: "Other cable", 80: "City bench", 81: "Rubbish bin",
    82: "Small container", 83: "Large container", 84: "Letter box", 85: "Parking meter", 86: "EV charging station",
    87: "Fire hydrant", 88: "Bicycle rack", 89: "Advertising sign", 90: "Hanging streetlight", 91: "Terrace",
    92: "Playgorund", 93: "Electrical box", 94: "Concrete block", 95: "Construction sign", 98: "Other object", 99: "Noise",
}

# Codes of the older scheme and what they are now.
OLD_TO_NEW = {0: 0, 1: 9, 2: 10, 3: 30, 4: 60, 5: 62, 6: 61, 7: 40, 8: 80, 9: 81, 10: 1, 11: 79, 13: 70, 14: 90, 99: 99}


def label_table(spark: SparkSession) -> DataFrame:
    """``label, name``: the 56 classes."""
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])).alias("label", "name"))


def relabel(label: Column) -> Column:
    """Translate a code of the older scheme; codes without a counterpart become 0, codes above the scheme raise."""
    known = F.create_map(*[F.lit(x) for kv in OLD_TO_NEW.items() for x in kv])
    top = max(OLD_TO_NEW)
    return F.when(label > top, F.raise_error(F.concat(F.lit("label above the scheme: "), label.cast("string"))).cast("int")).otherwise(F.coalesce(F.try_element_at(known, label.cast("int")), F.lit(UNKNOWN)))
