"""Plans: tables derived from the given data and the queries over them."""
