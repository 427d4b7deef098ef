"""Usage-telemetry analytics for LLM assistants, written as PySpark DataFrame functions."""
