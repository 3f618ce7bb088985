"""tidegauge: sensor telemetry analytics expressed as Spark DataFrame transformations."""
