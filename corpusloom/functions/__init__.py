"""Column expressions: native, no Python workers."""
