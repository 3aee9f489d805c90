"""Registered queries: each inventory ID with its Spark plan and its SQL oracle."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def load_all():
    from voxelmill.catalog import (  # noqa: F401
        manifests, metrics, volumes, measures, textures, logs, rowsonly, checked, fields)
    return QUERIES, ORACLES
