"""Relational, graph, clustering and evaluation operators over DataFrames."""
