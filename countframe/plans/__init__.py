"""Named query plans over the test tables (see catalog.py)."""
