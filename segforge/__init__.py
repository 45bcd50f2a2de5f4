"""segforge: analytics over multilingual segment collections, Spark first."""

__version__ = "0.1.0"
