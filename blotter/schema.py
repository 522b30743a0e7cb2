"""Column names and types of an incident table."""

from pyspark.sql import types as T

# The 22 header names of a raw incident file.
RAW_COLUMNS = [
    "ID",
    "Case Number",
    "Date",
    "Block",
    "IUCR",
    "Primary Type",
    "Description",
    "Location Description",
    "Arrest",
    "Domestic",
    "Beat",
    "District",
    "Ward",
    "Community Area",
    "FBI Code",
    "X Coordinate",
    "Y Coordinate",
    "Year",
    "Updated On",
    "Latitude",
    "Longitude",
    "Location",
]

# The timestamp format of the raw `Date` and `Updated On` text.
INCIDENT_TS = "MM/dd/yyyy hh:mm:ss a"

INCIDENT_RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

POINT = T.StructType(
    [T.StructField("lat", T.DoubleType()), T.StructField("long", T.DoubleType())]
)

_TYPED = {
    "ID": T.LongType(),
    "Date": T.TimestampType(),
    "Arrest": T.BooleanType(),
    "Domestic": T.BooleanType(),
    "Beat": T.IntegerType(),
    "District": T.IntegerType(),
    "Ward": T.IntegerType(),
    "Community Area": T.IntegerType(),
    "X Coordinate": T.IntegerType(),
    "Y Coordinate": T.IntegerType(),
    "Year": T.IntegerType(),
    "Updated On": T.TimestampType(),
    "Latitude": T.DoubleType(),
    "Longitude": T.DoubleType(),
    "Location": POINT,
}

INCIDENT_TYPED = T.StructType(
    [
        T.StructField(c.replace(" ", "_"), _TYPED.get(c, T.StringType()))
        for c in RAW_COLUMNS
    ]
)
