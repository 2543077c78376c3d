"""DataFrame operators, grouped by the kind of traffic data they work on."""
