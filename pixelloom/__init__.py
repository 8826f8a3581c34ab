"""pixelloom: raster-image documents as Spark DataFrames."""

__version__ = "0.1.0"
