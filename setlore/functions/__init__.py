"""Scalar functions as column expressions; Arrow UDFs where SQL cannot state the rule."""
