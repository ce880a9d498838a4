"""Plans: compositions of operators that answer a whole question."""
