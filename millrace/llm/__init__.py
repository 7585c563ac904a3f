"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package imports it. ``queries`` and ``oracles`` in
:mod:`millrace.llm.registry` list the queries it offers.
"""
