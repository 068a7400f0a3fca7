"""KPI movement analytics on PySpark."""
