"""Storage between jobs, and the loops that have no plan of their own: closure, components, strongly connected components, ranks."""
