"""Incident analytics on Spark DataFrames.

Every public function takes DataFrames (or column names) and returns a lazy
DataFrame; nothing is collected to the driver except fitted model parameters.
"""
