"""Governance jobs for model-API traffic and text corpora, as DataFrame programs.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing runs until the caller triggers an action.
"""
