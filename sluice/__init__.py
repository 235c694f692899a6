"""sluice: stream-style SQL over tables and streams, on PySpark."""
