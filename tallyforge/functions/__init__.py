"""Scalar functions as columns; pandas UDFs only for what the engine has no function for."""
