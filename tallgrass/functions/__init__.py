"""Part of the retail analytics engine."""
