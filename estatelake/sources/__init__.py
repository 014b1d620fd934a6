"""Readers of landed payloads and writers: JSON statistics, registries, cubes, change feeds, pages, GeoJSON, archives."""
