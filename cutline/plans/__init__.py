"""Whole audits composed from the operators. Only rules and single numbers reach the driver."""
