"""Analytics for labelled grids and the graphs derived from them, as Spark DataFrame plans."""
