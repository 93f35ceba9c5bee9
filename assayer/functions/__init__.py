"""Column functions: no DataFrame, no session, everything stays inside code generation."""
