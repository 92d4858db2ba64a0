"""Website analytics and text-corpus jobs as PySpark DataFrames."""
