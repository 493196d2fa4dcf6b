"""Readers of tables, source trees, histories and coverage artefacts."""
