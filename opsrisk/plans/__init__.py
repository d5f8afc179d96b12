"""Jobs composed from operators, end to end."""
