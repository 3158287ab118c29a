"""The analyses: one function per statement and business question, plus the registry."""
