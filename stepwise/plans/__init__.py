"""Compositions of operators: bindings to concrete tables, feature builds,
analyst templates, EDA analyses, dashboard tables and loaders."""
