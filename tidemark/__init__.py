"""Event-feed analytics on Spark: as-of lookups, windowed event aggregates, grids, features, labels and scores."""
