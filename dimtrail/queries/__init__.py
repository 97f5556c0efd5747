"""Registered queries over the shared tables, and the same as SQL."""

from dimtrail.queries import actions, explained, files, history, judging, lifecycle, small, stored

MODULES = (history, judging, files, actions, lifecycle, small, stored, explained)
REGISTERED = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
