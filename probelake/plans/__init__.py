"""Query plans on the driver tables: stand-in inputs, operator queries and their SQL twins."""
