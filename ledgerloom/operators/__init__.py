"""Reusable DataFrame operators: star joins and data-quality rules."""
