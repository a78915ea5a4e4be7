"""Registered queries over the shared tables and their SQL counterparts."""

from cellgrid.catalogue import model_queries, prep_queries, shape_queries, voxel_queries

_MODULES = (prep_queries, voxel_queries, shape_queries, model_queries)


def all_queries():
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in _MODULES for name, sql in m.sql().items()}
