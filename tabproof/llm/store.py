"""Intermediate tables in the folder that all executors share."""

from tabproof.session import Bucketed, Stored, stored

__all__ = ["Bucketed", "Stored", "stored"]
