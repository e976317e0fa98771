"""Sources and sinks: tables in and out, as Spark reads and writes them."""
