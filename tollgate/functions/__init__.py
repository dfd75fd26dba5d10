"""Column expressions: no UDFs, all inside code generation where Spark allows it."""
