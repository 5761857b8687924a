"""sheaf: Spark-native analytics for document-conversion fleets.

Operators take and return DataFrames; nothing here collects data to the driver.
"""

__version__ = "0.1.0"
