"""A PySpark engine for input-output economics: tables as long cell frames, derived matrices as lazy plans."""
