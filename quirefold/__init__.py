"""Preparation of long-form documents at corpus scale, as Spark columns and DataFrames."""
