"""Queries over the driver's tables; each module registers its own."""
