"""weftline: a Spark-first engine for cross-species contact-map comparison."""
