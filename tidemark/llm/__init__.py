"""Operators of a large-scale training-data pipeline. ``queries`` registers them; nothing else imports this package."""
