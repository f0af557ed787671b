"""Operators of a training-data pipeline; nothing else in the package imports this folder.

One module per operator (a general ``DataFrame -> DataFrame`` interface), ``queries`` with the thin registered
queries, ``oracle`` with their DuckDB SQL.
"""
