"""flowspark: record routing and dataflow operators on Spark DataFrames."""

from flowspark.records import attr, attribute_map, content_size, to_records

__all__ = ["attr", "attribute_map", "content_size", "to_records"]
__version__ = "0.1.0"
