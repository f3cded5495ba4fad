"""Analytics over hierarchical property graphs and change histories, as Spark plans."""
