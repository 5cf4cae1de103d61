"""Part of the leafmill syntax-tree analytics engine."""
