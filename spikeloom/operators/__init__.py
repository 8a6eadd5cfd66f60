"""Operators over recordings, signals, units and edits."""
