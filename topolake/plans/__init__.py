"""Named queries over the driver's tables and the graph fixtures, each with its SQL."""
