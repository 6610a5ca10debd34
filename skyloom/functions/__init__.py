"""Column expressions: geodesy, rotations, camera model, angles."""
