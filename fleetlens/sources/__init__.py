"""Readers: files of many bundles to DataFrames."""
