"""Point-in-time feature auditing on Spark: as-of reconstruction, leakage verdicts, evidence."""
