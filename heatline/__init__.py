"""heatline: telemetry cleaning and first-order thermal identification on PySpark."""
