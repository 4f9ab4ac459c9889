"""Column functions of the transcript domain, exact to the reference's semantics where built-ins differ."""
