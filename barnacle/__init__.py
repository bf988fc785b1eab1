"""Barcode counting for sequencing screens on Spark."""
