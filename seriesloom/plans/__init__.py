"""Whole analyses from readings to result documents."""
