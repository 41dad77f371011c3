"""Training-data curation on Spark: contamination checks, scoring, selection and provenance."""

__version__ = "0.1.0"
