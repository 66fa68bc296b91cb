"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator is a plain
function from DataFrame to DataFrame; :mod:`panelkit.llm.queries` registers one
query per operator.
"""
