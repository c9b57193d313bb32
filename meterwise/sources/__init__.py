"""Inputs: driver tables, derived fixtures, snapshot landing files, source registry."""
