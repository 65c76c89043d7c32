"""Parcel screening as set-oriented Spark jobs."""
