"""DataFrame jobs: joins, upserts, point clouds, labels, weather."""
