"""Part of the loomlake engine."""
