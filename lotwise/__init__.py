"""Parcel scoring on Spark: DataFrame-to-DataFrame operators keyed by ``parcel_id``."""
