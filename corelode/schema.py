"""Relations, required columns and fixed tables of the assay domain."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLES = T.StructType([
    T.StructField("SampleID", T.StringType(), False),
    T.StructField("Hole_ID", T.StringType(), False),
    T.StructField("DataSet", T.StringType(), False),
    T.StructField("Element", T.StringType(), False),
    T.StructField("standardized_grade_ppm", T.DoubleType()),
    T.StructField("Depth_From", T.DoubleType()),
    T.StructField("Depth_To", T.DoubleType()),
    T.StructField("Interval_Length", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("LabCode", T.StringType()),
])

REQUIRED = {
    "hole_samples": [f.name for f in SAMPLES.fields],
    "hole_grades": ["Hole_ID", "Element", "DataSet", "weighted_grade", "From_m", "To_m", "Interval_m"],
    "collars": ["Hole_ID", "LL_Lat", "LL_Long", "Elevation"],
}

# Configured elements and datasets.
ELEMENTS = ["Cu", "Au", "Zn", "Pb", "Fe", "Ag"]
DATASETS = ["Drilling_INF", "Drilling_BF", "Drilling_OP"]

# The order in which a question is searched for an element.
QUESTION_ORDER = ["Au", "Cu", "Zn", "Pb", "Fe", "Ag"]

# Economic grade limits in ppm (element, high, medium, low).
ECONOMIC_LIMITS = [
    ("CU", 5000.0, 1000.0, 100.0),
    ("AU", 10.0, 2.0, 0.5),
    ("AG", 100.0, 20.0, 5.0),
    ("PB", 10000.0, 2000.0, 500.0),
    ("ZN", 20000.0, 5000.0, 1000.0),
    ("MO", 1000.0, 200.0, 50.0),
    ("FE", 300000.0, 100000.0, 20000.0),
    ("S", 50000.0, 10000.0, 2000.0),
    ("AS", 1000.0, 200.0, 50.0),
    ("SB", 500.0, 100.0, 20.0),
]

# The concentration that maps to full heat, and the default.
HEAT_MAXIMUM = {"Cu": 8957.488006, "Au": 11.904356, "Zn": 79453.322416}
HEAT_DEFAULT = 1000.0

# Validation limits.
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
DEPTH_RANGE = (0.0, 10000.0)
REQUEST_DEPTH_RANGE = (0.0, 1000.0)
GRADE_MAXIMUM = 1000000.0
INTERVAL_TOLERANCE = 0.01

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
ROCK_DENSITY = 2.7
RECOVERY = 0.85
EPSILON = 1e-8
Z_95 = 1.96

# Cutoff grades in ppm.
CUTOFFS = [100, 500, 1000, 2000, 5000]

# Columns of a flat prediction file.
PREDICTION_COLUMNS = [
    "latitude", "longitude", "depth_from", "depth_to", "element",
    "predicted_grade_ppm", "confidence_lower", "confidence_upper", "prediction_timestamp",
]

POINTS_CSV = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("depth_from", T.DoubleType()),
    T.StructField("depth_to", T.DoubleType()),
])
