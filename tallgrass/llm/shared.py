"""Intermediate tables of the text operators: written to the folder that all executors share."""

from tallgrass.sources.scratch import Scratch, Table, shared_dir

__all__ = ["Scratch", "Table", "shared_dir"]
