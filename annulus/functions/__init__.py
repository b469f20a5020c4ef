"""Scalar functions from columns to columns."""
