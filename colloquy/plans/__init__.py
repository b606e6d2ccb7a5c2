"""Parameter tables and schema versions."""
