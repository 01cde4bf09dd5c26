"""Registered queries, their SQL counterparts and multi-operator flows."""
