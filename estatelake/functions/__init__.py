"""Scalar functions: Column expressions that stay in generated code."""
