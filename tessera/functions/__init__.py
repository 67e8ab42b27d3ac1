"""Scalar and vector functions built from Catalyst expressions."""
