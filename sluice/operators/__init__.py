"""Operators from DataFrame to DataFrame; usable without the SQL front end."""
